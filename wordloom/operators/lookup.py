"""Joins of words, ranges and times. None compares all pairs: each derives keys that a hash join can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.similarity import osa
from wordloom.profiles import HEBREW, MIN_STEM, Profile
from wordloom.session import materialize, small, spread

#: Places that the words which share a form of one letter or none are split over.
PARTS = 16


def ids(tokens: DataFrame, lex: DataFrame, token: str = "token", id_: str = "id", **more: str) -> DataFrame:
    """``tokens`` with the lexicon id ``id_`` of the word in column ``token``, null where it has none; ``more`` names further
    ids and the columns of their words, which are dropped."""
    side = small(lex.select("word", "word_id"))
    out = tokens
    for name, column in {id_: token, **more}.items():
        word = side.select(F.col("word").alias("_lex_word"), F.col("word_id").alias(name))
        out = out.join(word, F.col(column) == F.col("_lex_word"), "left").drop("_lex_word")
    return out.drop(*more.values())


def stems(words: DataFrame, lex: DataFrame, p: Profile = HEBREW, min_stem: int = MIN_STEM) -> DataFrame:
    """(word, prefix, stem) of the words that are in the lexicon, as they stand (prefix empty) or after the longest prefix
    whose rest is a word of at least ``min_stem`` letters. ``words`` has distinct words."""
    known = small(lex.select(F.col("word").alias("stem")))
    literal = words.select("word").join(known, F.col("word") == F.col("stem"), "left_semi").select("word", F.lit("").alias("prefix"), F.col("word").alias("stem"))
    rest = words.select("word").filter(F.length("word") > min_stem).join(known, F.col("word") == F.col("stem"), "left_anti")
    options = F.array_compact(F.array(*(F.when(F.col("word").startswith(x) & (F.length("word") >= len(x) + min_stem), F.lit(x)) for x in p.prefixes)))
    cut = rest.select("word", F.explode(options).alias("prefix")).withColumn("stem", F.expr("substring(word, length(prefix) + 1)"))
    hits = cut.join(known, "stem", "left_semi")
    best = hits.groupBy("word").agg(F.min_by(F.struct("prefix", "stem"), F.struct(-F.length("prefix"), "prefix")).alias("b"))
    return literal.unionByName(best.select("word", "b.prefix", "b.stem"))


def chains(words: DataFrame, lex: DataFrame, letters: str = "והבכלמש") -> DataFrame:
    """(word, prefix, stem): up to three leading prefix letters off a known stem of two or more, most letters first."""
    options = F.array_compact(F.array(*(F.when(F.col("word").rlike(rf"\A[{letters}]{{{n}}}.{{2,}}\z"), F.lit(n)) for n in (3, 2, 1))))
    cut = words.select("word", F.explode(options).alias("n")).withColumn("stem", F.expr("substring(word, n + 1)"))
    hits = cut.join(small(lex.select(F.col("word").alias("stem"))), "stem", "left_semi")
    return hits.groupBy("word").agg(F.max("n").alias("n")).select("word", F.expr("substring(word, 1, n)").alias("prefix"), F.expr("substring(word, n + 1)").alias("stem"))


def by_prefix(prefixes: DataFrame, lex: DataFrame, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """(prefix, word_id, word, log_freq) of every word that begins with a prefix: one equi-join on each word's own beginnings.
    Prefixes may have any length from 1. A caller who knows the lengths of all ``prefixes`` may name them: shorter and longer
    beginnings are then not made."""
    if lengths is None:
        heads = F.transform(F.when(F.length("word") > 0, F.sequence(F.lit(1), F.length("word"))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    else:
        heads = F.array_compact(F.array(*(F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in lengths)))
    words = lex.select("word_id", "word", "log_freq", F.explode(heads).alias("prefix"))
    return words.join(prefixes.select("prefix").distinct(), "prefix").select("prefix", "word_id", "word", "log_freq")


def prefix_tree(lex: DataFrame) -> DataFrame:
    """(prefix, depth, words, first_id, last_id, ends) of every beginning of a word: how many words begin so, the range of their ids,
    and whether it is a word itself. Ids must follow the words' order: words between two that share a beginning share it
    too, so a node whose range is wider than its words tells of an unsorted lexicon (see ``unsorted``)."""
    heads = F.transform(F.when(F.length("word") > 0, F.sequence(F.lit(1), F.length("word"))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    rows = lex.select("word_id", "word", F.explode(heads).alias("prefix"))
    return rows.groupBy("prefix").agg(F.length("prefix").alias("depth"), F.count("*").alias("words"), F.min("word_id").alias("first_id"), F.max("word_id").alias("last_id"), F.max(F.col("word") == F.col("prefix")).alias("ends"))


def unsorted(tree: DataFrame) -> DataFrame:
    """The nodes that only an unsorted lexicon, or one with repeated words, can have."""
    return tree.filter(F.col("last_id") - F.col("first_id") + 1 != F.col("words"))


def deletions(word: Column, most: int = 2) -> Column:
    """Array of a word and what is left of it after up to ``most`` letters are dropped."""
    out = F.array(word)
    level = out
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))))
        out = F.array_union(out, level)
    return out


def _segment(i: int, n: Column, parts: int) -> tuple[Column, Column]:
    """(start from 1, length) of the ``i``-th of ``parts`` segments that a word of ``n`` letters is cut into."""
    lo, hi = F.floor(n * i / parts).cast("int"), F.floor(n * (i + 1) / parts).cast("int")
    return lo + 1, hi - lo


def _long_pairs(typed: DataFrame, lex: DataFrame, edits: int, longest: int) -> DataFrame:
    """(typed, word_id, word, log_freq): candidates within ``edits`` edits of which a side has over ``longest`` letters.

    An edit touches two neighbouring segments at most, a swap over their border, so of 2 * edits + 1 segments of a typed
    word one is whole in each word near it, at most ``edits`` letters from its place. Words are cut for each length that
    a typed word near them may have.
    """
    parts = 2 * edits + 1
    long = lambda c: F.length(c) > longest - edits
    def cut(word: str, n: Column, shift: int) -> Column:
        out = []
        for i in range(parts):
            at, size = _segment(i, n, parts)
            out.append(F.when((at + shift >= 1) & (at + shift + size <= F.length(word) + 1), F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(F.col(word), at + shift, size).alias("part"))))
        return F.array_compact(F.array(*out))

    left = typed.select("typed").filter(long("typed")).distinct().select("typed", F.explode(cut("typed", F.length("typed"), 0)).alias("seg"))
    near = range(-edits, edits + 1)
    segs = F.array_distinct(F.flatten(F.array(*(cut("word", F.length("word") + k, shift) for k in near for shift in near))))
    right = lex.filter(long("word")).select("word_id", "word", "log_freq", F.explode(segs).alias("seg"))
    return left.join(right, "seg").filter((F.length("typed") > longest) | (F.length("word") > longest)).select("typed", "word_id", "word", "log_freq").distinct()


def fuzzy(typed: DataFrame, lex: DataFrame, edits: int = 2, longest: int = 12) -> DataFrame:
    """(typed, word_id, word, log_freq, cost): words within ``edits`` edits of each distinct typed word, cost in hundredths.

    Two words that near share a form that is left of both after as many deletions, so candidates come from one
    equi-join; they are verified after duplicates are dropped. Where a side has over ``longest`` letters, whose forms would
    be many, candidates share a segment instead. Empty and null words find nothing. Nothing is cut off before ranking.
    """
    left = typed.select("typed").filter(F.length("typed").between(1, longest)).distinct()
    # Very short forms are left of many words: those of one typed word meet all others' in one of several places.
    short = F.length("form") <= 1
    left = left.select("typed", F.explode(deletions(F.col("typed"), edits)).alias("form")).withColumn("part", F.when(short, F.pmod(F.hash("typed"), F.lit(PARTS))).otherwise(0))
    right = spread(lex.filter(F.length("word") <= longest)).select("word_id", "word", "log_freq", F.explode(deletions(F.col("word"), edits)).alias("form"))
    right = right.withColumn("part", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))))
    near = left.join(right, ["form", "part"]).filter(F.abs(F.length("typed") - F.length("word")) <= edits).select("typed", "word_id", "word", "log_freq").distinct()
    near = near.union(_long_pairs(typed, lex, edits, longest))
    # The built-in distance counts a swap as two edits. It settles most pairs; the fold runs only where a swap is possible.
    lev, a, b = F.levenshtein("typed", "word", 2 * edits), F.split("typed", ""), F.split("word", "")
    swap = (F.size(F.array_except(a, b)) < edits) & (F.size(F.array_except(b, a)) < edits)
    near = near.withColumn("_lev", lev).filter("_lev >= 0").withColumn("_swap", swap).filter((F.col("_lev") <= edits) | ((F.col("_lev") <= 2 * edits) & F.col("_swap")))
    cost = F.when((F.col("_lev") < 2) | ~F.col("_swap"), F.col("_lev") * 100).otherwise(osa(F.col("typed"), F.col("word")))
    return near.withColumn("cost", cost).filter(F.col("cost") <= 100 * edits).drop("_lev", "_swap")


def swapped(word: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Array of the words that differ by one letter of a pair, either way."""
    both = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    def at(i: Column) -> Column:
        c = F.substring(word, i, F.lit(1))
        return F.array_compact(F.array(*(F.when(c == a, F.concat(F.substring(word, F.lit(1), i - 1), F.lit(b), F.substring(word, i + 1, F.length(word)))) for a, b in both)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), at)))


def confusions(words: DataFrame, lex: DataFrame, p: Profile = HEBREW) -> DataFrame:
    """(word, variant, variant_id, variant_freq): known words one confusable letter away from each distinct word."""
    v = words.select("word", F.explode(swapped(F.col("word"), p.confusions)).alias("variant"))
    side = small(lex.select(F.col("word").alias("variant"), F.col("word_id").alias("variant_id"), F.col("log_freq").alias("variant_freq")))
    return v.join(side, "variant").select("word", "variant", "variant_id", "variant_freq")


def dropped_twins(lex: DataFrame, letters: str = "וי") -> DataFrame:
    """(word, twin): pairs of known words of which one lacks a vowel letter of the other."""
    spots = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)).isin(*letters))
    cut = F.transform(spots, lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    cand = lex.select("word", F.explode(F.array_distinct(cut)).alias("twin"))
    return cand.join(small(lex.select(F.col("word").alias("twin"))), "twin", "left_semi").select("word", "twin")


def final_twins(words: DataFrame, lex: DataFrame, p: Profile = HEBREW) -> DataFrame:
    """(word, twin): words ending in a letter that has a final form, and the known word that ends in that."""
    last = F.right("word", F.lit(1))
    to = F.translate(last, "".join(a for a, _ in p.finals), "".join(b for _, b in p.finals))
    cand = words.filter(last.isin(*(a for a, _ in p.finals))).select("word", F.concat(F.expr("substring(word, 1, length(word) - 1)"), to).alias("twin"))
    return cand.join(small(lex.select(F.col("word").alias("twin"))), "twin", "left_semi").select("word", "twin")


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(a_id, b_id) of closed intervals (id, lo, hi) of either side that meet.

    Intervals are cut at multiples of ``width`` and joined by cell; a pair is kept in the cell of its first common point
    only. Intervals with a null end or lo > hi meet nothing.
    """
    def cells(df: DataFrame, s: str) -> DataFrame:
        ok = df.filter(F.col("lo") <= F.col("hi"))
        return ok.select(F.col("id").alias(f"{s}_id"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("cell"))

    both = cells(a, "a").join(cells(b, "b"), "cell").filter("a_lo <= b_hi AND b_lo <= a_hi")
    return both.filter(F.col("cell") == F.floor(F.greatest("a_lo", "b_lo") / width)).select("a_id", "b_id")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the last right row of its key at or before it, null if there is none.

    Both sides' rows are put into ranges of key and time, and each range is run through once; no pair is compared. A key
    of many rows lies in several ranges: what it has seen by the end of each is carried into the next, at most two rows a
    range. Of right rows at the same time the greatest by ``take`` is last. Rows without a time come first and find
    nothing; they are no right rows. Left rows without a key find nothing.
    """
    kind = f"struct<{','.join(f'`{c}`:{right.schema[c].dataType.simpleString()}' for c in take)}>"
    a = left.withColumn("_side", F.lit(1)).withColumn("_take", F.lit(None).cast(kind))
    b = right.filter(F.col(at).isNotNull() & F.col(by).isNotNull()).select(by, at, F.lit(0).alias("_side"), F.struct(*take).alias("_take"))
    order = [F.col(at).asc_nulls_first(), "_side", "_take"]
    both = a.unionByName(b, allowMissingColumns=True).repartitionByRange(by, *order)
    both = materialize(both.withColumn("_p", F.spark_partition_id()), "as-of")
    w = Window.partitionBy("_p", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_last", F.last("_take", ignorenulls=True).over(w)).filter("_side = 1")
    ends = both.filter(F.col(by).isNotNull()).groupBy(by, "_p").agg(F.max(F.when(F.col("_side") == 0, F.struct(at, "_take"))).alias("_end"))
    several = ends.withColumn("_n", F.count("*").over(Window.partitionBy(by))).filter("_n > 1")
    before = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = several.select(by, "_p", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    found = own.join(F.broadcast(carried.select(F.col(by).alias("_k"), F.col("_p").alias("_q"), "_before")), (F.col(by) == F.col("_k")) & (F.col("_p") == F.col("_q")), "left")
    last = F.coalesce("_last", F.when(F.col(at).isNotNull(), F.col("_before")["_take"]))
    return found.withColumn("_found", last).select(*left.columns, *(F.col(f"_found.{c}").alias(f"last_{c}") for c in take))


def nearest_key(rects: list[tuple[str, int, float, float, float, float]], x: Column, y: Column) -> Column:
    """The letter of the key that holds a point, or is nearest to it; the keys are a literal, so nothing is joined."""
    def away(lo: float, hi: float, v: Column) -> Column:
        return F.greatest(F.lit(lo) - v, v - F.lit(hi), F.lit(0.0))

    spots = [F.struct((F.pow(away(left, right, x), F.lit(2.0)) + F.pow(away(top, bottom, y), F.lit(2.0))).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, _, left, top, right, bottom) in enumerate(rects)]
    return F.array_min(F.array(*spots))["c"]
