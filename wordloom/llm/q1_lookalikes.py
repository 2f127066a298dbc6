"""p1 queries: records whose texts look the same but hold different characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.llm import lookalikes as L
from wordloom.session import materialize, table


def _pairs(prints, tbl):
    return L.lookalike_pairs(materialize(prints, f"p1-{tbl}")).select(F.lit(tbl).alias("tbl"), "key_a", "key_b")


def p1_found(spark, d):
    items = L.item_prints(table(spark, d, "label_items", "id", "sentence", "options"))
    forms = L.form_prints(table(spark, d, "verb_forms", "form_id", "vocalized_inflection"))
    return _pairs(items, "label_items").unionByName(_pairs(forms, "verb_forms"))


def p1_forms(spark, d):
    """Each distinct verb form with its consistent form, and whether it has tokens that are mixed-script or whole-script confusable."""
    df = table(spark, d, "verb_forms", "form_id", "vocalized_inflection").distinct()
    df = df.withColumn("form", L.normalized(F.col("vocalized_inflection"))).withColumn("f", L.flags_udf("vocalized_inflection"))
    return df.select("form_id", "vocalized_inflection", "form", "f.mixed", "f.whole")


def p1_classes(spark, d):
    """Each labelling item with the class of items that look like it (its least id) and the class's size."""
    prints = L.item_prints(table(spark, d, "label_items", "id", "sentence", "options"))
    classes = prints.groupBy("look").agg(F.min("key").alias("class_id"), F.countDistinct("key").alias("n_items"))
    return prints.join(classes, "look").select(F.col("key").alias("id"), "class_id", "n_items").distinct()


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p1_classes": p1_classes}
SQL: dict[str, str] = {}
