"""Correction, completion, next word, real-word errors: candidates, evidence, one deterministic order, a cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.similarity import adjacency_map, osa
from wordloom.operators import lookup as L
from wordloom.plans import tables as T
from wordloom.profiles import BIGRAM_WEIGHT, COMPLETION_CANDIDATES, DETECT_MARGIN, HEBREW, MAX_EDITS, MIN_STEM, MIN_TYPED, NEXT_CANDIDATES, PRIOR_MARGIN, SUGGESTIONS, USER_CAP, USER_WEIGHT, Profile
from wordloom.session import materialize, small


def top(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in a total order, ranked from 1. The filter on the rank lets the planner cut each
    partition before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def valid(words: DataFrame, lex: DataFrame, personal: DataFrame | None = None, min_stem: int = MIN_STEM) -> DataFrame:
    """(word) of the distinct words that are known, as they stand or after a prefix."""
    known = lex.select("word") if personal is None else lex.select("word").union(personal.select("word")).distinct()
    return L.stems(words, known, min_stem=min_stem).select("word")


def candidates(typed: DataFrame, lex: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """Candidates of the distinct typed words that are long enough and not valid. The checks come cheapest first."""
    long = typed.select(F.col("typed").alias("word")).filter(F.length("word") >= MIN_TYPED).distinct()
    wrong = long.join(valid(long, lex), "word", "left_anti").select(F.col("word").alias("typed"))
    return L.fuzzy(wrong, lex, edits)


def suggestions(cand: DataFrame, n: int = SUGGESTIONS) -> DataFrame:
    """The best corrections of each typed word: cost, then frequency, then id."""
    return top(cand, ["typed"], [F.col("cost"), F.desc("log_freq"), F.col("word_id")], n)


def truncated(cand: DataFrame, most: int) -> DataFrame:
    """The first ``most`` candidates of each typed word in the words' order, as a search that stops there finds them; ``hit`` counts
    them. Nothing else cuts candidates off."""
    return top(cand, ["typed"], [F.col("word")], most, "hit")


def reranked(cand: DataFrame, p: Profile = HEBREW, adjacent_cost: int = 80) -> DataFrame:
    """Candidates with the cost of another model: the set stays as the neutral model retrieved it."""
    return cand.withColumn("cost", osa(F.col("typed"), F.col("word"), adjacency_map(p), adjacent_cost))


def auto_replaced(cand: DataFrame, most: int = 100, margin: int = 0) -> DataFrame:
    """(typed, word) of words replaced unasked: the best costs little and is attested, and it is alone or clearly ahead."""
    w = Window.partitionBy("typed").orderBy("cost", F.desc("log_freq"), "word_id")
    r = cand.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("cost").over(w)).filter("rank = 1")
    return r.filter((F.col("cost") <= most) & (F.col("log_freq") > 0) & (F.col("next").isNull() | (F.col("next") - F.col("cost") > margin))).select("typed", "word")


def user_term(log: Column, weight: float = USER_WEIGHT, cap: int = USER_CAP) -> Column:
    return weight * F.least(F.coalesce(log, F.lit(0)), F.lit(cap))


def completions(contexts: DataFrame, lex: DataFrame, bigrams: DataFrame, lengths: tuple[int, ...] | None = None, n: int = SUGGESTIONS, bigram_weight: float = BIGRAM_WEIGHT, user: DataFrame | None = None, score: Column | None = None) -> DataFrame:
    """(prefix, prev, word_id, word, log_freq, score, rank) for distinct contexts (prefix, prev); ``prev`` may be null. ``score`` is an
    expression of one's own over word, log_freq and log_count (null without a pair) instead of the usual sum.

    Of each prefix the most frequent 24 words are candidates; the prefix itself is dropped after that. ``lengths``: see
    ``lookup.by_prefix``. ``user`` is one
    model's gated pairs (first_id, second_id, log_count); rows then also say whether the word owes its place to it.
    """
    cand = top(L.by_prefix(contexts, lex, lengths), ["prefix"], [F.desc("log_freq"), F.col("word_id")], COMPLETION_CANDIDATES, "place").filter("word <> prefix")
    rows = contexts.select("prefix", "prev").distinct().join(cand, "prefix")
    side = small(bigrams.select(F.col("first_id").alias("prev"), F.col("second_id").alias("word_id"), "log_count"))
    rows = rows.join(side, ["prev", "word_id"], "left")
    rows = rows.withColumn("score", F.col("log_freq") + bigram_weight * F.coalesce("log_count", F.lit(0)) if score is None else score)
    order = [F.desc("score"), F.desc("log_freq"), F.col("word_id")]
    if user is None:
        return top(rows, ["prefix", "prev"], order, n).select("prefix", "prev", "word_id", "word", "log_freq", "score", "rank")
    mine = small(user.select(F.col("first_id").alias("prev"), F.col("second_id").alias("word_id"), F.col("log_count").alias("mine")))
    rows = rows.join(mine, ["prev", "word_id"], "left").withColumn("term", user_term(F.col("mine")))
    w = Window.partitionBy("prefix", "prev")
    rows = rows.withColumn("alone", F.row_number().over(w.orderBy(*order))).withColumn("score", F.col("score") + F.col("term"))
    ranked = top(rows, ["prefix", "prev"], order, n)
    return ranked.select("prefix", "prev", "word_id", "word", "log_freq", "score", "rank", ((F.col("term") > 0) & (F.col("alone") > n)).alias("from_user"))


def next_words(bigrams: DataFrame, user: DataFrame | None = None, n: int = SUGGESTIONS) -> DataFrame:
    """(first_id, second_id, score, rank): of each first word the best continuations out of the corpus's 16 and the user's 16."""
    cut = lambda df: top(df, ["first_id"], [F.desc("cnt"), F.col("second_id")], NEXT_CANDIDATES)
    rows = cut(bigrams).select("first_id", "second_id", F.col("log_count").cast("double").alias("s"))
    if user is not None:
        rows = rows.unionByName(cut(user).select("first_id", "second_id", user_term(F.col("log_count")).alias("s")))
    scored = rows.groupBy("first_id", "second_id").agg(F.sum("s").alias("score")).filter("second_id >= 0")
    return top(scored, ["first_id"], [F.desc("score"), F.col("second_id")], n)


def mixed(finishes: DataFrame, fixes: DataFrame, policy: str = "COMPLETIONS_FIRST", n: int = SUGGESTIONS) -> DataFrame:
    """(typed, word, kind, rank) from two ranked lists (typed, word, rank); a word in both keeps its better place."""
    a, b = finishes.select("typed", "word", "rank", F.lit("COMPLETION").alias("kind")), fixes.select("typed", "word", "rank", F.lit("CORRECTION").alias("kind"))
    both = a.unionByName(b)
    second = F.when(F.col("kind") == ("CORRECTION" if policy != "CORRECTIONS_FIRST" else "COMPLETION"), 1).otherwise(0)
    place = F.col("rank") * 2 + second if policy == "INTERLEAVED" else second * 1_000_000 + F.col("rank")
    first = both.withColumn("place", place).groupBy("typed", "word").agg(F.min(F.struct("place", "kind")).alias("p"))
    return top(first.select("typed", "word", "p.kind", "p.place"), ["typed"], [F.col("place")], n).select("typed", "word", "kind", "rank")


def sites(sents: DataFrame, lex: DataFrame) -> DataFrame:
    """Known tokens with the ids of the tokens one and two before and after, null where there is none or it is unknown."""
    t = T.neighbours(sents, 2, 2).filter(F.length("token") >= 2).withColumnRenamed("n", "_n").withColumn("_w", F.col("token"))
    t = L.ids(t, lex, "_w", prev2="w-2", prev="w-1", next="w1", next2="w2")
    return t.drop("_w", "_n").filter(F.col("id").isNotNull())


def _looked_up(rows: DataFrame, counts: DataFrame, before: str, word: str, after: str, name: str) -> DataFrame:
    """``rows`` with the counts of a word after the one before and before the one after, summed up as ``name``."""
    for first, second, part in ((before, word, "_a"), (word, after, "_b")):
        rows = rows.join(counts.select(F.col("first_id").alias(first), F.col("second_id").alias(second), F.col("log_count").alias(part)), [first, second], "left")
    return rows.withColumn(name, F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).drop("_a", "_b")


def evidence(found: DataFrame, lex: DataFrame, bigrams: DataFrame, skips: DataFrame | None = None, p: Profile = HEBREW) -> DataFrame:
    """One row per site and variant: the counts that speak for the typed word and for the variant, adjacent and at distance
    two, and both words' frequencies. Sweeps read this table instead of looking anything up again.

    Counts are looked up once per distinct surroundings of a word, not per site: frequent words cost no more than others.
    """
    freq = small(lex.select("word", F.col("word_id").alias("id"), F.col("log_freq").alias("typed_freq")))
    conf = small(L.confusions(lex.select("word"), lex, p).join(freq, "word").select("id", "typed_freq", "variant", "variant_id", "variant_freq"))
    found = materialize(found.join(conf.select("id"), "id", "left_semi"), "sites")
    rows = found
    tables = [(bigrams, "prev", "next", "")] + ([(skips, "prev2", "next2", "_skip")] if skips is not None else [])
    first = True
    for counts, before, after, tail in tables:
        side = small(counts.select("first_id", "second_id", "log_count"))
        ctx = found.select(before, "id", after).distinct()
        ctx = _looked_up(ctx, side, before, "id", after, f"typed_ev{tail}").join(conf.select("id", "variant_id"), "id")
        ctx = _looked_up(ctx, side, before, "variant_id", after, f"variant_ev{tail}")
        ctx = ctx.select(F.col(before).alias("_x"), F.col("id").alias("_i"), F.col(after).alias("_y"), F.col("variant_id").alias("_v"), f"typed_ev{tail}", f"variant_ev{tail}")
        on = (F.col("id") == F.col("_i")) & F.col(before).eqNullSafe(F.col("_x")) & F.col(after).eqNullSafe(F.col("_y"))
        if first:
            rows = rows.join(ctx, on).withColumnRenamed("_v", "variant_id").drop("_x", "_i", "_y")
        else:
            rows = rows.join(ctx, on & (F.col("variant_id") == F.col("_v"))).drop("_x", "_i", "_y", "_v")
        first = False
    rows = rows.join(conf, ["id", "variant_id"])
    return rows.withColumn("context", F.col("prev").isNotNull().cast("int") + F.col("next").isNotNull().cast("int"))


SITE = ["doc_id", "sent_id", "pos"]


def detected(ev: DataFrame, margin: int = DETECT_MARGIN, require_zero: bool = True, by: list[str] | None = None) -> DataFrame:
    """The best variant of each site where the context knows it well and the typed word not at all; ties by id."""
    ok = ev.filter((F.col("context") > 0) & (F.col("variant_ev") - F.col("typed_ev") >= margin))
    if require_zero:
        ok = ok.filter("typed_ev = 0")
    return top(ok, by or SITE, [F.desc("variant_ev"), F.col("variant_id")], 1).drop("rank")


def detected_wide(ev: DataFrame, margin: int = DETECT_MARGIN, skip_margin: int = 0, prior_margin: int = PRIOR_MARGIN, by: list[str] | None = None) -> DataFrame:
    """As ``detected``; where the adjacent words say nothing of any word, the words at distance two, and where those don't
    speak either, frequency alone. A margin of 0 switches its layer off. ``path`` tells which layer spoke."""
    by = by or SITE
    near = detected(ev, margin, by=by).withColumn("path", F.lit("adjacent")).withColumn("strength", F.col("variant_ev"))
    blind = ev.withColumn("_any", F.max(F.greatest("typed_ev", "variant_ev")).over(Window.partitionBy(*by))).filter("_any = 0").drop("_any")
    out, rest = near, blind
    if skip_margin > 0:
        ok = blind.filter((F.col("prev2").isNotNull() | F.col("next2").isNotNull()) & (F.col("typed_ev_skip") == 0) & (F.col("variant_ev_skip") - F.col("typed_ev_skip") >= skip_margin))
        far = top(ok, by, [F.desc("variant_ev_skip"), F.col("variant_id")], 1).drop("rank")
        out = out.unionByName(far.withColumn("path", F.lit("distance-2")).withColumn("strength", F.col("variant_ev_skip")))
        rest = blind.join(far.select(*by), by, "left_anti")
    if prior_margin > 0:
        ok = rest.filter(F.col("variant_freq") - F.col("typed_freq") >= prior_margin)
        out = out.unionByName(top(ok, by, [F.desc("variant_freq"), F.col("variant_id")], 1).drop("rank").withColumn("path", F.lit("prior")).withColumn("strength", F.col("variant_freq").cast("int")))
    return out


def offered(contexts: DataFrame, lex: DataFrame, bigrams: DataFrame, abbr: DataFrame, n: int = SUGGESTIONS, user: DataFrame | None = None, edits: int = MAX_EDITS) -> DataFrame:
    """(current, prev, word, kind, rank) of distinct contexts (current, prev): all that a word begun after a known word ``prev`` (an id
    or null) could be offered, ranked within its kind.

    Nothing begun, or a whole abbreviation of ``abbr`` (bare, canonical): next words. Letters that abbreviate a form: that form, and
    completions if they are a word themselves, else corrections. Anything that isn't letters: nothing. A known word (as it
    stands or after a prefix): completions. Other letters: completions and corrections. The rank of an abbreviation is 0 if
    it leads and 1 if it comes second.
    """
    contexts = materialize(contexts.select(F.coalesce("current", F.lit("")).alias("current"), "prev").distinct(), "contexts")
    words = contexts.filter("current <> ''").select(F.col("current").alias("word")).distinct().withColumn("bare", X.strip_marks(F.col("word")))
    info = words.join(abbr.select(F.col("canonical").alias("word"), F.lit(True).alias("whole")), "word", "left")
    info = info.join(abbr.select("bare", F.col("canonical").alias("form")), "bare", "left").withColumn("form", F.when(F.col("form") != F.col("word"), F.col("form")))
    info = info.join(lex.select("word", F.lit(True).alias("listed")), "word", "left").join(valid(words.filter(X.is_word(F.col("word"))), lex).select("word", F.lit(True).alias("valid")), "word", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    info = materialize(info.select("word", "form", flag(F.col("whole")).alias("whole"), flag(F.col("listed")).alias("listed"), flag(F.col("valid")).alias("valid"), X.is_word(F.col("word")).alias("letters")), "words")
    rows = contexts.join(small(info.withColumnRenamed("word", "current")), "current", "left")
    names = small(lex.select(F.col("word_id").alias("second_id"), "word"))
    nxt = next_words(bigrams, user, n).join(names, "second_id").select(F.col("first_id").alias("prev"), "word", "rank")
    out = rows.filter((F.col("current") == "") | F.col("whole")).select("current", "prev").join(nxt, "prev").select("current", "prev", "word", F.lit("NEXT_WORD").alias("kind"), "rank")
    begun = rows.filter((F.col("current") != "") & ~F.col("whole"))
    forms = begun.filter("form IS NOT NULL").select("current", "prev", F.col("form").alias("word"), F.lit("ABBREVIATION").alias("kind"), F.col("listed").cast("int").alias("rank"))
    finish = begun.filter(F.col("letters") & (F.col("form").isNull() | F.col("listed"))).select(F.col("current").alias("prefix"), "prev")
    finish = completions(finish, lex, bigrams, n=n, user=user).select(F.col("prefix").alias("current"), "prev", "word", F.lit("COMPLETION").alias("kind"), "rank")
    unsure = begun.filter(F.col("letters") & ~F.col("valid") & (F.col("form").isNull() | ~F.col("listed")))
    fixes = suggestions(candidates(unsure.select(F.col("current").alias("typed")), lex, edits), n).select(F.col("typed").alias("current"), "word", "rank")
    fixes = unsure.select("current", "prev").join(fixes, "current").select("current", "prev", "word", F.lit("CORRECTION").alias("kind"), "rank")
    return out.unionByName(forms).unionByName(finish).unionByName(fixes)


def arranged(offers: DataFrame, policy: str = "COMPLETIONS_FIRST", n: int = SUGGESTIONS) -> DataFrame:
    """(current, prev, word, kind, rank): what is offered, in one order, cut to ``n``; ``policy`` mixes completions and corrections. A word
    offered twice keeps its better place."""
    first, second = {"CORRECTIONS_FIRST": (1_000_000, 0), "INTERLEAVED": (0, 1)}.get(policy, (0, 1_000_000))
    kind, rank = F.col("kind"), F.col("rank")
    # A listed word's completions stand at 2, 4, ...: its abbreviation comes between the first and the second.
    place = F.when((kind == "ABBREVIATION") & (rank == 0), -1).when(kind == "ABBREVIATION", 3 + first).when(kind == "COMPLETION", rank * 2 + first).when(kind == "CORRECTION", rank * 2 + second).otherwise(rank)
    best = offers.withColumn("place", place).groupBy("current", "prev", "word").agg(F.min(F.struct("place", "kind")).alias("p")).select("current", "prev", "word", "p.kind", "p.place")
    return top(best, ["current", "prev"], [F.col("place"), F.col("word")], n).drop("place")


def ordinary(contexts: DataFrame, lex: DataFrame, bigrams: DataFrame, abbr: DataFrame, policy: str = "COMPLETIONS_FIRST", n: int = SUGGESTIONS, **more) -> DataFrame:
    """(current, prev, word, kind, rank): see ``offered`` and ``arranged``."""
    return arranged(offered(contexts, lex, bigrams, abbr, n, **more), policy, n)


def predicted(requests: DataFrame, keys: list[str], lex: DataFrame, bigrams: DataFrame, abbr: DataFrame, skips: DataFrame | None = None, policy: str = "COMPLETIONS_FIRST", n: int = SUGGESTIONS, edits: int = MAX_EDITS, skip_margin: int = 0) -> DataFrame:
    """(keys, word, kind, replaces, rank) of requests (keys, current, c1, c2, c3, c4): the word begun and those completed before it,
    the nearest first; null where there is none.

    The second last completed word has known words on both sides; if it looks like another word's error, that finding
    comes first and the ordinary suggestions follow, ``n`` in all. Both are worked out once per distinct surroundings.
    Points are taken off before words are looked up; ``replaces`` is the word as it was written.
    """
    r = requests.select(*keys, F.coalesce(X.strip_points(F.col("current")), F.lit("")).alias("current"), F.col("c2").alias("replaces"), F.length("c2").alias("_len"), *(X.strip_points(F.col(c)).alias(c) for c in ("c1", "c2", "c3", "c4")))
    r = L.ids(r, lex, "c1", "next", id="c2", prev="c3", prev2="c4").drop("c1")
    r = materialize(r.withColumn("next2", F.lit(None).cast("int")), "requests")
    around = ["prev2", "prev", "id", "next"]
    ev = evidence(r.filter("id IS NOT NULL AND _len >= 2").select(*around, "next2").distinct(), lex, bigrams, skips)
    hit = detected_wide(ev, skip_margin=skip_margin, by=around).select(*(F.col(c).alias(f"_{c}") for c in around), F.col("variant").alias("found"))
    on = (F.col("id") == F.col("_id")) & F.col("prev2").eqNullSafe(F.col("_prev2")) & F.col("prev").eqNullSafe(F.col("_prev")) & F.col("next").eqNullSafe(F.col("_next"))
    r = r.join(hit, on, "left").select(*keys, "current", F.col("next").alias("prev"), "replaces", F.when(F.col("_len") >= 2, F.col("found")).alias("found"))
    r = materialize(r, "found")
    plain = ordinary(r.select("current", "prev"), lex, bigrams, abbr, policy, n, edits=edits).select(F.col("current").alias("_c"), F.col("prev").alias("_p"), "word", "kind", "rank")
    usual = r.join(plain, (F.col("current") == F.col("_c")) & F.col("prev").eqNullSafe(F.col("_p"))).select(*keys, "word", "kind", F.lit(None).cast("string").alias("replaces"), (F.col("rank") + F.col("found").isNotNull().cast("int")).alias("rank")).filter(F.col("rank") <= n)
    flagged = r.filter("found IS NOT NULL").select(*keys, F.col("found").alias("word"), F.lit("REAL_WORD_ERROR").alias("kind"), "replaces", F.lit(1).alias("rank"))
    return flagged.unionByName(usual)
