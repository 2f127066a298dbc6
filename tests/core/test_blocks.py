"""Blocks: every text is packed and read again."""

import hashlib

from wordloom.queries import flows


def test_every_text_is_a_block(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else ["a", "b"][i % 2], [f"שלום {i} 👍", "", " \n", "x" * 5000, None][i % 5]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in flows.q_src5_blocks(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, t in rows if t is not None}
    harmed = {i for (i,) in spark.range(400).filter("pmod(xxhash64(id), 16) < 2").collect()} & set(got)
    assert {i for i, r in got.items() if not r.ok} == harmed and 20 < len(harmed) < 80
    for i, source, t in rows:
        if i in got:
            r = got[i]
            assert r.source == source
            assert (r.chars, r.digest) == ((None, None) if i in harmed else (len(t), hashlib.md5(t.encode()).hexdigest()))
