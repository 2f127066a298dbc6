"""Edits near and beyond the ninth letter of a name."""

from test_lookup import osa

from wordloom.queries import text


def edited(key, a):
    return [a, a[:2] + a[3:], a[:2] + a[3:4] + a[2:3] + a[4:], "q" + a][key % 4]


def test_whole_names(spark, tmp_path):
    names = ["lace spring azure", "lace spring ivory", "lace", "ab", "misty lavender blush", "aabb", "x" * 40, "", None]
    rows = [(k, n) for n in names for k in range(4)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = {(n, edited(k, n), 100 * osa(n, edited(k, n))) for k, n in rows if n is not None}
    got = text.q_sim1_osa_whole_names(spark, str(tmp_path)).collect()
    assert {(r.a, r.b, r.osa) for r in got} == {x for x in want if x[2] <= 100} and len(got) == len({(r.a, r.b) for r in got})
    assert {"lace spring azure", "lace spring ivory", "x" * 40} <= {r.a for r in got}
