"""p9: texts whose end is missing."""

from wordloom.llm import cutoffs

FILL = ["the cat sat on the mat", "we went home after the show", "rain fell on the old town", "the show was long"]


def whole(n):
    return [" ".join(f"{FILL[(i + j) % 4].capitalize()}." for j in range(1 + i % 5)) for i in range(n)]


def corpus():
    rows = [(i, t, "notes", len(t)) for i, t in enumerate(whole(300))]
    # A source where closing signs are optional; "thanks" only ever ends texts.
    rows += [(1000 + i, t.rstrip(".") + (" thanks" if i % 3 == 0 else ""), "chat", None) for i, t in enumerate(whole(300))]
    return rows


CASES = [
    (5000, "The cat sat on the ma", "notes", 21, "unclosed"),
    (5001, "The cat sat on the mat", "notes", 90, "figure"),
    (5002, "The cat sat on the mat�", "chat", None, "broken"),
    (5003, "The cat sat on (the mat", "chat", None, "open"),
    (5004, "The cat sat on the", "chat", None, "word"),
    (5005, "Rain fell on the ol", "chat", None, "word"),
    (5006, "Rain fell on [[the mat", "chat", None, "open"),
    (5007, "Rain fell &am", "chat", None, "open"),
    (5008, "```\ncode", "notes", None, "open"),
    (5009, "Rain fell 👨‍", "chat", None, "broken"),
    (5010, "We went home,", "chat", None, "open"),
    (5011, "The cat sat on the mat. We went home after the show.", "notes", 400, "figure"),
    (6000, "We went home after the show", "chat", 27, None),
    (6001, "Rain fell on the mat thanks", "chat", 27, None),
    (6002, None, "notes", None, None),
    (6003, "", "notes", 0, None),
    (6004, " \n​", "notes", 3, None),
    (6005, "(We went home.)", "notes", 15, None),
    (6006, "שלום עולם.", "notes", len("שלום עולם.".encode()), None),
    (6007, "# Head\n\n```\na | b\n```", "notes", None, None),
    (6008, 'We said "home."', "notes", None, None),
    (6009, "We went home 👍", "notes", None, None),
    (6010, "The cat <b>sat</b> on the mat.", "notes", None, None),
    (6011, "a ) b ] c.", "notes", None, None),
]


def test_cases(spark):
    rows = corpus() + [c[:4] for c in CASES]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    got = {r.doc_id: r for r in cutoffs.judge(df).collect()}
    assert len(got) == len(rows)
    for i, text, _, _, why in CASES:
        assert got[i].why == why and got[i].cut == (why is not None), (text, got[i])
    assert not [r for i, r in got.items() if i < 5000 and r.cut]


def test_field_limits(spark):
    rows = corpus()
    base = "rain fell on the old town and the show was long and we went home after the show "
    rows += [(2000 + i, (f"{i} " + FILL[i % 4] + " " + base * 3)[:150], "chat", None) for i in range(40)]
    rows += [(3000 + i, (FILL[i % 4] + " " + base * 3)[: 30 + 3 * i], "chat", None) for i in range(38) if 30 + 3 * i != 150]
    rows += [(4000, base[:60] + "x" * 89 + ".", "chat", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").withColumn("f", cutoffs.features_udf("text"))
    feats = df.select("doc_id", "source", "n_chars", cutoffs.F.xxhash64("text").alias("hash"), "f.*")
    at = {r.doc_id for r in cutoffs.at_limits(feats).collect()}
    assert {i for i in at if i >= 2000} == set(range(2000, 2040)) and 4000 not in at


def test_nulls_repeats_empty(spark):
    rows = [(1, "A b c.", None, None), (1, "A b c.", None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    got = cutoffs.judge(df)
    assert sorted((r.doc_id, r.cut) for r in got.collect()) == [(1, False), (2, False)]
    report = cutoffs.by_source(got).collect()
    assert [(r.source, r.n_texts, r.n_cut) for r in report] == [(None, 1, 0)]
    assert cutoffs.judge(df.limit(0)).count() == 0


def test_automaton():
    assert [s for s, _ in cutoffs.left_open("a (b [c")] == ["(", "["]
    assert cutoffs.left_open("a (b [c) d") == [] and cutoffs.left_open('say "x" (y) [[z]] {{w}} <b>q</b>') == []
    assert [s for s, _ in cutoffs.left_open("```\n( [ \"")] == ["```"]
    assert cutoffs.left_open("צה\"ל נ\"ב") == []
    cutoffs.end_of("(" * 200_000)


def test_cuts_do_not_lift_the_baseline(spark):
    """A source that closes its texts but cuts many at a field limit, in markup or short of their figure."""
    rows = corpus()
    base = "rain fell on the old town and the show was long and we went home after the show "
    rows += [(3000 + i, t, "mail", None) for i, t in enumerate(whole(200))]
    rows += [(3300 + i, (f"{i} " + FILL[i % 4] + " " + base * 3)[:150], "mail", None) for i in range(60)]
    rows += [(3400 + i, "rain and " * (i + 1) + f"wind (number {i}", "mail", None) for i in range(30)]
    rows += [(3500 + i, f"{i} " + "then " * (2 * i) + "we went home after the show", "mail", 900) for i in range(30)]
    late = [(3600 + i, f"Number {i}. " + "Rain fell. " * (3 * i) + "We went home after the show", "mail", None) for i in range(5)]
    df = spark.createDataFrame(rows + late, "doc_id bigint, text string, source string, n_chars bigint")
    got = {r.doc_id: r.why for r in cutoffs.judge(df).collect()}
    assert [got[i] for i, *_ in late] == ["unclosed"] * 5
    assert not [i for i, w in got.items() if w and i < 3300]
    assert {got[3300 + i] for i in range(60)} <= {"limit", "unclosed"} and {got[3500 + i] for i in range(30)} == {"figure"}
    assert {got[3400 + i] for i in range(30)} <= {"open", "limit"}
