"""p7: ids equal to the public library's, offsets and round trips."""

import os
import random

import pytest

from wordloom.llm import bpe

JSON = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.json")
HARD = [
    "", " ", "  ", "\n", "a", " a", "  a", "a ", "a  ", "a\n\nb", "a \n b", "a\t b", "a  'sb", "it's", "it''s", " 's", "\n's", "'s", "''s", "x'll'll", "x'lx", "I'M", "we're've'd",
    "'", "''", "a'", "don't!'t", "!'s", " !'s", "1's2", "12ab34", "½²ⅷ", "<|endoftext|> x", "שלום עולם", "שָׁלוֹם", "👨‍👩‍👧 👍🏽", "a　b", " x", "a\x85b", "\x1c x", "​ x",
    "'s's's", "'ss", "'llx", " 'll", "\r\n 'd", "é", "日本語テキスト", "🇮🇱", "x" * 300, "א" * 1000, "!" * 700, " " * 900, "ab'" * 100, "﻿x", "�",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(JSON):
        pytest.skip("no tokenizer files here")
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    ids, counts, _ = bpe.encode_texts(texts, bpe.cache(bpe.TOKENIZER, bpe.TOKENIZER_DIR))
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n])
        at += n
    return out


def test_hard_cases(reference):
    for t, a, b in zip(HARD, ours(HARD), reference(HARD), strict=True):
        assert a == b, repr(t)


def test_random_texts(reference):
    rnd = random.Random(3)
    letters = ["a", "s", "t", "l", "e", "r", "v", "'", "'", " ", " ", "\n", "\t", "1", "٣", "!", "-", "א", "ב", "ָ", "é", "👍", " ", "　", "‍", "中"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 60))) for _ in range(4000)]
    for t, a, b in zip(texts, ours(texts), reference(texts), strict=True):
        assert a == b, repr(t)


def test_blocks_and_batches(reference, monkeypatch):
    texts = HARD * 3
    monkeypatch.setattr(bpe, "MOST", 50)
    monkeypatch.setattr(bpe, "BLOCK", 5)
    assert ours(texts) == reference(texts)


def test_very_long_pieces(reference):
    texts = ["ab" * 60_000, "אבג" * 20_000, "=-" * 50_000]
    assert ours(texts) == reference(texts)


def test_spark_null_empty_roundtrip(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", bpe_lit())
    enc = bpe.encode(df, offsets=True)
    got = {r.doc_id: r for r in enc.collect()}
    assert got[-1].ids == [] and got[-2].ids == [] and len(got) == len(rows)
    back = {r.doc_id: r.text for r in bpe.decode(enc).collect()}
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    words = {v: k for k, v in bpe.ranks(bpe.TOKENIZER, bpe.TOKENIZER_DIR).items()}
    for i, t in enumerate(HARD):
        assert back[i] == t and counts[i] == len(got[i].ids)
        data = t.encode()
        assert all(data[s : s + len(words[x])] == words[x] for s, x in zip(got[i].starts, got[i].ids, strict=True))
    assert bpe.encode(df.limit(0)).count() == 0


def bpe_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
