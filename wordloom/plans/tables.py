"""Statistical tables of a corpus: sentences, tokens, lexicon, adjacent and distance-2 pairs, blends, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.numeric import log_scale, table_bytes
from wordloom.operators.windows import numbered
from wordloom.profiles import HEBREW, Profile
from wordloom.session import small


def sentence_tokens(docs: DataFrame, p: Profile = HEBREW, least: int = 1) -> DataFrame:
    """(doc_id, source, sent_id, tokens): sentences of at least ``least`` tokens, numbered within their text. Narrow."""
    s = docs.select("doc_id", "source", F.posexplode(X.sentences(F.col("text"), p)).alias("sent_id", "s"))
    return s.select("doc_id", "source", "sent_id", X.tokens(F.col("s"), p).alias("tokens")).filter(F.size("tokens") >= least)


def explode_tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, source, sent_id, pos, n, token), n being the sentence's length."""
    return sents.select("doc_id", "source", "sent_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))


def neighbours(sents: DataFrame, before: int = 1, after: int = 0) -> DataFrame:
    """As ``explode_tokens``, with the tokens before (w-1, w-2, ...) and after (w1, ...) each, null where there is none. They are
    taken inside the sentence's array, so nothing is shuffled."""
    near = [(k, f"w{k}") for k in (*range(-before, 0), *range(1, after + 1))]
    at = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), *(F.get("tokens", i + k).alias(name) for k, name in near)))
    rows = sents.select("doc_id", "source", "sent_id", F.size("tokens").alias("n"), F.posexplode(at).alias("pos", "t"))
    return rows.select("doc_id", "source", "sent_id", "pos", "n", "t.*")


def counted(words: DataFrame, word: str = "token") -> DataFrame:
    """(word, cnt)."""
    return words.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("cnt"))


def lexicon(counts: DataFrame, min_count: int = 5) -> DataFrame:
    """(word_id, word, cnt, log_freq): ids follow the words' code-point order from 0."""
    kept = numbered(counts.filter(F.col("cnt") >= min_count), ["word"], "word_id")
    return kept.select(F.col("word_id").cast("int").alias("word_id"), "word", "cnt", log_scale(F.col("cnt")).cast("smallint").alias("log_freq"))


def _pair_counts(sents: DataFrame, distance: int) -> DataFrame:
    ahead = F.slice("tokens", F.lit(1 + distance), F.greatest(F.size("tokens") - distance, F.lit(0)))
    near = F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - distance, F.lit(0)))
    pairs = sents.filter(F.size("tokens") > distance).select(F.explode(F.zip_with(near, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("cnt"))


def pairs(sents: DataFrame, lex: DataFrame, distance: int = 1) -> DataFrame:
    """(first_id, second_id, cnt) of tokens ``distance`` apart in a sentence. A token outside the lexicon ends adjacency at
    distance 1, and is passed over at distance 2. Words are counted first and looked up after, once per pair."""
    ids = small(lex.select("word", "word_id"))
    counts = _pair_counts(sents, distance)
    for side in ("a", "b"):
        counts = counts.join(ids.select(F.col("word").alias(side), F.col("word_id").alias(f"{side}_id")), side)
    return counts.select(F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"), "cnt")


def bigrams(sents: DataFrame, lex: DataFrame) -> DataFrame:
    return pairs(sents, lex, 1)


def skipgrams(sents: DataFrame, lex: DataFrame) -> DataFrame:
    return pairs(sents, lex, 2)


def pruned(counts: DataFrame, min_count: float) -> DataFrame:
    """Pairs of at least ``min_count``, with their scaled count."""
    return counts.filter(F.col("cnt") >= min_count).withColumn("log_count", log_scale(F.col("cnt")))


def blend(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """(1 - weight) of one table's counts plus weight of the other's, whichever has the pair."""
    both = a.select("first_id", "second_id", (F.col("cnt") * (1 - weight)).alias("c")).unionByName(b.select("first_id", "second_id", (F.col("cnt") * weight).alias("c")))
    return both.groupBy("first_id", "second_id").agg(F.sum("c").alias("cnt"))


def top_pairs(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent pairs, ties by id."""
    return counts.orderBy(F.desc("cnt"), "first_id", "second_id").limit(most)


def capped(counts: DataFrame, most: int) -> DataFrame:
    """Per first word the ``most`` most frequent continuations, ranked from 1, ties by id."""
    w = Window.partitionBy("first_id").orderBy(F.desc("cnt"), "second_id")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def thresholds(counts: DataFrame, floors: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50, 100)) -> DataFrame:
    """(floor, pairs, mass, groups, bytes) that stay at each minimum count. Each first word's pairs are gathered into one row
    of sums per floor before anything is counted over words."""
    over = F.array(*(F.when(F.col("cnt") >= t, F.struct(F.lit(t).alias("floor"), F.lit(1).alias("one"))) for t in floors))
    rows = counts.select("first_id", "cnt", F.explode(F.array_compact(over)).alias("t")).groupBy("first_id", F.col("t.floor").alias("floor")).agg(F.count("*").alias("n"), F.sum("cnt").alias("m"))
    out = rows.groupBy("floor").agg(F.sum("n").alias("pairs"), F.sum("m").alias("mass"), F.count("*").alias("groups"))
    return out.withColumn("bytes", table_bytes(F.col("groups"), F.col("pairs")))


def size_grid(counts: DataFrame, floors: tuple[int, ...] = (2, 5, 10), caps: tuple[int, ...] = (1, 4, 16, 64)) -> DataFrame:
    """(floor, cap, pairs, groups, bytes) of a table cut both ways."""
    over = F.array_compact(F.array(*(F.when(F.col("cnt") >= t, F.lit(t)) for t in floors)))
    sizes = counts.select("first_id", F.explode(over).alias("floor")).groupBy("first_id", "floor").agg(F.count("*").alias("n"))
    rows = sizes.select("floor", "n", F.explode(F.array(*map(F.lit, caps))).alias("cap"))
    out = rows.groupBy("floor", "cap").agg(F.sum(F.least("n", "cap")).alias("pairs"), F.count("*").alias("groups"))
    return out.withColumn("bytes", table_bytes(F.col("groups"), F.col("pairs")))


def abbreviations(texts: Column, df: DataFrame, min_count: int = 10) -> DataFrame:
    """(bare, canonical, cnt): marked forms of a corpus by their letters, phonetic spellings left out."""
    forms = df.select(F.explode(X.abbreviations(texts)).alias("f")).select(X.canonical(F.col("f")).alias("canonical"))
    counts = forms.groupBy("canonical").agg(F.count("*").alias("cnt")).filter((F.col("cnt") >= min_count) & ~X.is_phonetic(F.col("canonical")))
    return counts.select(X.strip_marks(F.col("canonical")).alias("bare"), "canonical", "cnt")


def unambiguous(abbr: DataFrame) -> DataFrame:
    """Only the letters that abbreviate one form."""
    one = abbr.groupBy("bare").agg(F.count("*").alias("n"), F.max("canonical").alias("canonical"), F.max("cnt").alias("cnt"))
    return one.filter("n = 1").drop("n")
