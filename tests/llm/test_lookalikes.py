"""p1: look-alike text."""

import itertools
import unicodedata

from wordloom.llm import lookalikes as L


def same(a, b):
    return L.normal_form(a) == L.normal_form(b)


def test_looks_alike():
    for a, b in [
        ("OK", "ОК"), ("OK", "ΟК"), ("OK", "ＯＫ"), ("Åsmer", "Åsmеr"), ("Porção", "Рοrс̧а̃ο"), ("SMS", "ЅМЅ"),
        ("אמת", "ℵמﬨ"), ("שָׁב", "שָׁב"), ("שָׁב", "שָׁב"), ("יִ", "יִ"), ("אל", "ﭏ"), ("החװה", "החווה"), ("צײר", "צייר"),
        ("סוס", "oוο"), ("שעון", "שעוl"), ("שעון", "שעוӀ"), ("חוסל", "חlסל"), ("‫אחרי‬", "אחרי"), ("יום הולדת ", "יום הולדת"),
        ("של­", "‏ש͏ל"), ("12", "１２"), ("Tiknó", "Τіknό"), ("כָ͏ּל", "כָּל"),
    ]:
        assert same(a, b), (a, b, L.normal_form(a), L.normal_form(b))


def test_differ():
    for a, b in [("הוא", "היא"), ("ו", "ן"), ("כָל", "כַל"), ("שָׁ", "שָׂ"), ("OK", "0K"), ("ok", "OK"), ("Email", "Emall"), ("סוס", "olo"), ("x²", "x2"), ("יום הולדת", "יוםהולדת"), ("café", "cafe")]:
        assert not same(a, b), (a, b)


def test_idempotent_and_nfc():
    for w in ["ΟК", "שעוl", "הGооgle", "⁧Ζｏｌｕｍａ⁩", "", " ", "ײַ", "á̧", "👨‍👩‍👧", "ﬀ…½"]:
        f = L.normal_form(w)
        assert L.normal_form(f) == f and unicodedata.normalize("NFC", f) == f
    assert L.normal_form(None) is None and L.normal_form("​ ") == ""
    assert L.normal_form("הGооgle") == "הGoogle"
    assert len(L.normal_form("א" * 100_000 + "o")) == 100_001


def test_flags():
    assert L.resolve("ΟК") == ("OK", True, False)
    assert L.resolve("ОК") == ("OK", False, True)
    assert L.resolve("שלום") == ("שלום", False, False)


def brute(rows):
    def look(r):
        return tuple(L.normal_form(w) for w in r[1]), tuple(sorted(L.normal_form(w) for w in r[2]))

    out = set()
    for a, b in itertools.product(rows, rows):
        if a[0] < b[0] and look(a) == look(b) and (a[1], sorted(a[2])) != (b[1], sorted(b[2])):
            out.add((a[0], b[0]))
    return out


def test_pairs_against_brute_force(spark):
    rows = [("a", ["OK", "של"], ["x", "y"]), ("b", ["ОК", "של"], ["y", "x"]), ("c", ["OK", "של"], ["y", "x"]), ("d", ["OK של"], ["y", "x"])]
    rows += [(f"h{i:03d}", ["א" + "​" * (i % 3)], ["", ""]) for i in range(60)]
    rows += rows[:3] + [("e", [], []), ("f", ["​"], []), ("g", [""], [])]
    df = spark.createDataFrame(rows, "id string, sentence array<string>, options array<string>").withColumn("key", L.F.lit(1)).withColumn("look", L.F.lit("z"))
    got = [(r.key_a, r.key_b) for r in L.lookalike_pairs(L.item_prints(df), block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert ("a", "b") in got and ("a", "c") not in got
    assert L.lookalike_pairs(L.item_prints(df.limit(0))).count() == 0


def test_forms_nulls(spark):
    df = spark.createDataFrame([("a", "ℵ"), ("b", "א"), ("c", None), ("d", None), (None, "א"), ("b", "א")], "form_id string, vocalized_inflection string")
    assert [(r.key_a, r.key_b) for r in L.lookalike_pairs(L.form_prints(df)).collect()] == [("a", "b")]
    items = spark.createDataFrame([("a", None, None), ("b", None, None), ("c", [None], ["א"])], "id string, sentence array<string>, options array<string>")
    assert L.lookalike_pairs(L.item_prints(items)).count() == 0


def test_whole_script_hebrew(spark, tmp_path):
    from wordloom.llm import q1_lookalikes as Q

    same_look = ["סוס", "оӀо", "olo", "oοо", "o\u200blо"]
    assert {L.look_form(w) for w in same_look if w != "oοо"} == {"סוס"} and L.look_form("oοо") == "ססס"
    assert L.look_form("וסוס, 1") == L.look_form("lolo, 1") and L.look_form("Olo lol-Email") == "Olo וסן-Email"
    assert L.look_form("סו") != L.look_form("סן") == L.look_form("ol") and L.look_form(None) is None
    words = ["סוס", "olo", "оӀо", "סון"]
    items = spark.createDataFrame([(str(i), [w], ["א", w]) for i, w in enumerate(words)], "id string, sentence array<string>, options array<string>")
    items.write.parquet(f"{tmp_path}/label_items.parquet")
    forms = spark.createDataFrame([(str(i), w) for i, w in enumerate([*words, None, "שлום", "של", "שol"])], "form_id string, vocalized_inflection string")
    forms.write.parquet(f"{tmp_path}/verb_forms.parquet")
    pairs = {("0", "1"), ("0", "2"), ("1", "2")}
    assert {tuple(r) for r in Q.p1_found(spark, str(tmp_path)).collect()} == {(t, *p) for t in ("label_items", "verb_forms") for p in pairs}
    assert {r.id: r.class_id for r in Q.p1_classes(spark, str(tmp_path)).collect()} == {"0": "0", "1": "0", "2": "0", "3": "3"}
    got = {r.form_id: (r.form, r.mixed, r.whole) for r in Q.p1_forms(spark, str(tmp_path)).collect()}
    assert [got[str(i)] for i in range(5)] == [("סוס", False, True)] * 3 + [("סון", False, True), (None, None, None)]
    assert got["6"] == ("של", False, False) and got["7"][1:] == (True, False)
