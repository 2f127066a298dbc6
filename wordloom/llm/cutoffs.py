"""p9: texts whose end is missing, and how often each source loses ends.

A stack automaton reads each text for what is still open at its end (quotes, brackets, markup, code fences, entities,
multi-byte sequences), and the end itself for a closing sign. What a missing closing sign means is told by the source's
own baseline over its texts that nothing else shows to be cut: where nearly every text closes, a text that doesn't is cut; where many don't, it is cut
only if something else says so: something left open, a last word that in the corpus never ends a sentence (or is no
word), a length at which the source's unclosed texts pile up, or a sender's figure of more characters than came.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.session import materialize, small

#: Signs that close a text (fixed values), besides pictures and symbols.
CLOSING = ".!?…‽。！？׃♪"
#: Signs after which a text goes on (fixed values).
DANGLING = ",;:–—-(/\\&@#=+*<{[|_،"
#: Below this share of unclosed texts, of those that nothing else shows to be cut, a source's texts are expected to close.
BASELINE = 0.25
#: A word ends sentences if at least this share of its occurrences before the text's end does.
ENDER = 0.02
#: A word ends texts if it is the last one of at least this share of the source-independent unclosed texts (and of 3).
SIGN_OFF = 0.01
#: How many times the background the texts of one length must be to count as a field's limit, and how many at least.
SPIKE, SPIKE_TEXTS = 8.0, 8
#: Widest gap that a cut at the last blank before a limit leaves, in characters.
WORD_GAP = 11

_SPECIAL = re.compile(r"```|\[\[|\]\]|\{\{|\}\}|<!--|-->|<[a-zA-Z/][^<>\n]*>?|[()\[\]{}]|(?<![^\s(\[])\"|\"(?![^\W_])")
_PAIRS = {")": "(", "]": "[", "}": "{", "]]": "[[", "}}": "{{", "-->": "<!--"}
_ESCAPE = re.compile(r"(?:&#?\w{0,8}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-Fa-f]?|https?:/{0,2}|www\.?)\Z")
_LABEL = re.compile(r"\[\d{1,2}:\d\d\](?: [^:\n]{1,40}:?)?\s*\Z")
WORD = r"[\p{L}\p{M}\p{Nd}_'-]"
_LAST = re.compile(r"[\w'֑-ֽֿׁ-ׂׄ-ׇׅ-]+\Z")


def left_open(text: str) -> list[tuple[str, int]]:
    """What the text has opened and not closed, outermost first, with its position. A closing sign that matches nothing
    is ordinary text; one that matches an outer opening closes what lies within."""
    stack: list[tuple[str, int]] = []

    def close(sign: str) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == sign:
                del stack[k:]
                return True
        return False

    for m in _SPECIAL.finditer(text):
        s, at = m[0], m.start()
        if s == "```":
            if not close(s):
                stack.append((s, at))
        elif stack and stack[-1][0] == "```":
            continue
        elif s == '"':
            if not close(s) and (at == 0 or text[at - 1] in " \t\n\r\xa0(["):
                stack.append((s, at))
        elif s in _PAIRS:
            close(_PAIRS[s])
        elif s[0] == "<" and s != "<!--":
            if s[-1] != ">" and m.end() == len(text):
                stack.append(("<", at))
        else:
            stack.append((s, at))
    return stack


def end_of(text: str) -> tuple[bool, bool, bool, bool, str | None]:
    """(closed, open, broken, list item, last word) of a text that isn't blank.

    broken: the end itself is damaged (replacement character, half an emoji sequence). open: something in the last
    line is left open, or the text stops at a sign after which it goes on. last word: None if the text doesn't end in one.
    """
    t = text.rstrip()
    if t[-1] == "‍" or t[-1] == "�":
        return False, True, True, False, None
    while t and unicodedata.category(t[-1]) in ("Cf", "Cc") or t[-1:].isspace():
        t = t[:-1]
    if not t:
        return True, False, False, False, None
    begins = t.rfind("\n") + 1
    line, stack = t[begins:], left_open(t)
    fence = any(s == "```" for s, _ in stack)
    in_line = fence or any(at >= begins for _, at in stack)
    opened = in_line or bool(_ESCAPE.search(line)) or bool(_LABEL.fullmatch(line)) or (t[-1] in DANGLING and not line.endswith("-->"))
    core = t
    while core and core[-1] in "\"')]}”’»`":
        core = core[:-1].rstrip()
    sign = core[-1:]
    closed = not fence and (bool(sign) and (sign in CLOSING or unicodedata.category(sign) in ("So", "Sk") or sign == "️") or (t.endswith("]]") and "[[" in line) or line.strip() == "```")
    item = line.lstrip()[:1] in ("*", "#", "•") and not closed
    last = None if closed else (m[0] if (m := _LAST.search(t)) else None)
    return closed and not in_line, opened, False, item, last


def _features(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        if t is None or not t.strip():
            out.append((True, 0, 0, 0, True, False, False, False, False, None))
        else:
            closed, opened, broken, item, last = end_of(t)
            out.append((False, len(t), len(t.encode("utf-8", "replace")), len(t) + sum(map("￿".__lt__, t)), closed, opened, broken, item, t.rstrip().endswith("…"), last))
    return pd.DataFrame(out, columns=["blank", "chars", "bytes", "units", "closed", "open", "broken", "item", "ellipsis", "last"])


_FLAGS, _SIZES = ("closed", "open", "broken", "item", "ellipsis"), ("chars", "bytes", "units")
_SHAPE = T.StructType([T.StructField("blank", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in _SIZES), *(T.StructField(n, T.BooleanType()) for n in _FLAGS), T.StructField("last", T.StringType())])
features_udf = F.pandas_udf(_features, _SHAPE)


def word_ends(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, n_end, n_last): its occurrences before a text's end, those of them that end a sentence or clause, and the
    texts that it ends. Counted over all texts; partial counts are made before the shuffle."""
    found = docs.select(F.explode(F.regexp_extract_all(F.rtrim(F.regexp_replace(text, r"[\s\p{Cf}]+\z", "")), F.lit(rf"{WORD}+(?:[.!?;,\n]|.|\z)"), F.lit(0))).alias("w"))
    found = found.groupBy("w").count()
    word = F.regexp_extract("w", rf"\A({WORD}+)", 1)
    after = F.substring("w", F.length(word) + 1, F.lit(1))
    rows = found.select(word.alias("word"), after.alias("after"), "count")
    return rows.groupBy("word").agg(
        F.sum(F.when(F.col("after") != "", F.col("count")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("after").isin(".", "!", "?", ";", ",", "\n"), F.col("count")).otherwise(0)).alias("n_end"),
        F.sum(F.when(F.col("after") == "", F.col("count")).otherwise(0)).alias("n_last"),
    )


def _spikes(lengths: DataFrame, size: str) -> DataFrame:
    """(source, size): lengths at which a source's unclosed texts pile up against the lengths on either side. Equal texts
    count once, else copies would make a pile."""
    counts = lengths.select("source", size, "hash").distinct().groupBy("source", size).count()
    w = Window.partitionBy("source").orderBy(size)
    side = lambda lo, hi: F.coalesce(F.sum("count").over(w.rangeBetween(lo, hi)), F.lit(0)) / (40 - WORD_GAP)
    counts = counts.withColumn("around", F.greatest(side(-40, -WORD_GAP - 1), side(WORD_GAP + 1, 40)))
    return counts.filter((F.col("count") >= SPIKE_TEXTS) & (F.col("count") >= SPIKE * (F.col("around") + 0.25))).select("source", size)


def at_limits(feats: DataFrame) -> DataFrame:
    """(doc_id) of unclosed texts, and of those ending in an ellipsis, that are as long as their source's field is wide.

    Three kinds of limits are sought one after the other, each among the texts that the ones before don't explain:
    characters, bytes (up to three fewer, where a character didn't fit, or two more, where half of one was replaced), and
    the source's longest text with a cut at the last blank before it.
    """
    cand = feats.filter("NOT blank AND (NOT closed OR ellipsis)").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "chars", "bytes", "hash")
    longest = feats.filter("NOT blank").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.max("chars").alias("longest"))
    chars = small(materialize(_spikes(cand, "chars"), "p9-chars"))
    by_chars = cand.join(chars, ["source", "chars"], "left_semi")
    rest = cand.join(chars, ["source", "chars"], "left_anti")
    near = small(materialize(_spikes(rest, "bytes").select("source", F.explode(F.sequence(F.col("bytes") - 3, F.col("bytes") + 2)).alias("bytes")).distinct(), "p9-bytes"))
    by_bytes = rest.join(near, ["source", "bytes"], "left_semi")
    rest = rest.join(near, ["source", "bytes"], "left_anti")
    soft = rest.join(small(materialize(longest, "p9-longest")), "source").withColumn("gap", F.col("longest") - F.col("chars"))
    shares = soft.select("source", "gap", "hash").distinct().groupBy("source").agg(
        F.count_if(F.col("gap") <= WORD_GAP).alias("near"), F.count_if(F.col("gap") == 0).alias("top"), F.count_if(F.col("gap").between(WORD_GAP + 1, 3 * WORD_GAP + 2)).alias("below")
    )
    edges = shares.filter((F.col("near") >= SPIKE_TEXTS) & (F.col("near") >= SPIKE / 2 * (F.col("below") / 2 + 0.5)) & (F.col("top") < 0.6 * F.col("near"))).select("source")
    by_word = soft.filter(F.col("gap") <= WORD_GAP).join(small(materialize(edges, "p9-edges")), "source", "left_semi")
    return by_chars.select("doc_id").union(by_bytes.select("doc_id")).union(by_word.select("doc_id"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, source, blank, cut, why) of each row of ``docs`` (doc_id, text, source, n_chars).

    ``why`` is the first of: broken, figure, limit, open, unclosed, word; null if the text is whole. Null, empty and blank
    texts are whole. Texts without a source are one source. A sender's figure counts as evidence only if it is larger
    than the characters that came and isn't their number of bytes or UTF-16 units. Rows repeated under one id are judged
    each, with one result per id.
    """
    feats = docs.select("doc_id", "source", "n_chars", F.xxhash64("text").alias("hash"), features_udf("text").alias("f")).select("doc_id", "source", "n_chars", "hash", "f.*").dropDuplicates(["doc_id"])
    feats = materialize(feats, "p9-features")
    key = F.coalesce("source", F.lit(""))
    limit = materialize(at_limits(feats).withColumn("limit", F.lit(True)), "p9-limit")
    open_end = ~F.col("closed")
    figure = (F.col("n_chars") > F.col("chars")) & (F.col("n_chars") != F.col("bytes")) & (F.col("n_chars") != F.col("units"))
    evident = (
        F.when(F.col("broken"), "broken")
        .when(F.coalesce(figure, F.lit(False)), "figure")
        .when(F.coalesce("limit", F.lit(False)), "limit")
        .when(open_end & F.col("open"), "open")
    )
    # Cuts that something else explains say nothing about how a source's whole texts end.
    base = feats.filter("NOT blank").join(limit, "doc_id", "left").filter(evident.isNull())
    base = base.groupBy(key.alias("s")).agg((F.count_if(open_end & ~F.col("item")) / F.count("*")).alias("unclosed_share"))
    base = small(materialize(base, "p9-baseline"))
    rest = feats.filter("NOT blank AND NOT closed AND last IS NOT NULL")
    words = materialize(word_ends(docs).join(rest.select(F.col("last").alias("word")).distinct(), "word", "left_semi"), "p9-words")
    n_rest = rest.join(limit, "doc_id", "left_anti").select("last", "hash").distinct().groupBy("last").count()
    total = n_rest.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("t")).first().t
    signs = n_rest.select(F.col("last").alias("word"), F.col("count").alias("n_off"))
    words = words.join(signs, "word", "left").select("word", ((F.col("n_end") >= F.greatest(F.lit(1.0), ENDER * F.col("n"))) | (F.coalesce("n_off", F.lit(0)) >= max(3.0, SIGN_OFF * total))).alias("ender"))
    # Closed texts have no last word: spread over many keys that match nothing, they are no one task's.
    ending = F.coalesce("last", F.concat(F.lit("\0"), F.pmod(F.hash("doc_id"), F.lit(1 << 16))))
    df = feats.join(limit, "doc_id", "left").join(base, key == F.col("s"), "left").withColumn("_last", ending).join(small(words), F.col("_last") == F.col("word"), "left")
    why = (
        F.when(F.col("blank"), None)
        .when(evident.isNotNull(), evident)
        .when(open_end & ~F.col("item") & (F.col("unclosed_share") < BASELINE), "unclosed")
        .when(open_end & F.col("last").isNotNull() & ~F.coalesce("ender", F.lit(False)), "word")
    )
    return df.select("doc_id", "source", "blank", why.alias("why")).select("doc_id", "source", "blank", F.col("why").isNotNull().alias("cut"), "why")


def by_source(judged: DataFrame) -> DataFrame:
    """Texts, cut texts and their share of each source; blank texts aren't counted."""
    return judged.filter("NOT blank").groupBy("source").agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / F.count("*")).alias("share"),
        *(F.count_if(F.coalesce(F.col("why") == w, F.lit(False))).alias(f"n_{w}") for w in ("broken", "figure", "limit", "open", "unclosed", "word")),
    )
