"""p3: samples that match target shares. p4: samples that stay as data grows.

p3: a record's cell is the set of categories it is in and its values of the other margins. Cell weights are raked by
iterative proportional fitting until every margin (the categories and all others) has its target. Each record gets
weighted exponential keys -ln(u) / weight, one per category that it could be drawn for, and is drawn for the category of
its least key; a category takes its least keys. What then falls short of a minimum or a goal is repaired: undrawn records
are added and records of several categories moved, along augmenting paths of a flow over cells, the scarcest categories
first. What no record can close is reported as residual gap.
p4: a record is in the sample if the hash of its identifier lies below its weight times a constant. The weight is the
largest the record ever had, so neither new records nor new rows of an old one can push a picked record out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import materialize, small

#: 13 hexadecimal digits of a digest: the most whose value a double holds exactly.
HASH_DIGITS = 13
#: Records of a category that one task sorts while its least keys are sought; a larger one is split.
PART_ROWS = 50_000


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the values alone: the same in every run, on every machine, in every layout of the rows."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double") / float(16**HASH_DIGITS)


def category(raw: Column) -> Column:
    """A category's name without case, blanks at the ends and anything from a colon on."""
    return F.lower(F.regexp_replace(F.substring_index(raw, ":", 1), r"\A\s+|\s+\z", ""))


def rake(counts: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """``counts`` of cells scaled until each margin (code of each cell, goal of each code) sums up to its goals, as far as empty
    cells allow. Any number of margins; their goals should have one total."""
    x = counts.astype(float)
    for _ in range(rounds):
        before = x
        for codes, goal in margins:
            have = np.bincount(codes, x, len(goal))
            x = x * np.divide(goal, have, out=np.zeros_like(have), where=have > 0)[codes]
        if np.abs(x - before).max(initial=0.0) < tolerance:
            break
    return x


def repair(free: dict[str, int], drawn: dict[tuple[str, str], int], can: dict[str, list[str]], wanted: dict[str, int], order: list[str]) -> tuple[dict[str, int], list[tuple[str, str | None, str, int]]]:
    """(records drawn per category, moves (cell, from category or None, to category, how many)).

    ``free`` are the undrawn records of each cell, ``drawn`` those of (cell, category), ``can`` the categories a cell's
    records may be drawn for. The categories are served in ``order``: each takes undrawn records, if need be by moving
    others on, and only failing that records of categories after it. In the end the first k categories together have as
    many records as they can have, for every k.
    """
    place = {s: i for i, s in enumerate(order)}
    have = {s: 0 for s in order}
    use = {(c, s): n for (c, s), n in drawn.items() if n}
    for (_, s), n in use.items():
        have[s] += n
    by = {s: [c for c, cats in can.items() if s in cats] for s in order}
    spare = dict(free)
    for goal in order:
        while have[goal] < wanted[goal]:
            # Breadth first: from a category to the cells that could serve it, on to the categories those serve now.
            back: dict[str, tuple[str, str]] = {}
            queue, seen, free_end, taken_end = deque([goal]), {goal}, None, None
            while queue and free_end is None:
                s = queue.popleft()
                for c in by[s]:
                    if spare.get(c, 0) > 0:
                        free_end = (c, s)
                        break
                    for t in can[c]:
                        if t not in seen and use.get((c, t), 0) > 0:
                            seen.add(t)
                            back[t] = (c, s)
                            queue.append(t)
                            if place[t] > place[goal] and (taken_end is None or place[t] > place[taken_end]):
                                taken_end = t
            if free_end is None and taken_end is None:
                break
            path, amount = [], wanted[goal] - have[goal]
            if free_end is not None:
                c, s = free_end
                path.append((c, None, s))
                amount = min(amount, spare[c])
            else:
                s = taken_end
                amount = min(amount, have[s])
            while s != goal:
                c, to = back[s]
                path.append((c, s, to))
                amount = min(amount, use[c, s])
                s = to
            for c, source, to in path:
                if source is None:
                    spare[c] -= amount
                else:
                    use[c, source] -= amount
                use[c, to] = use.get((c, to), 0) + amount
            have[goal] += amount
            if free_end is None:
                have[taken_end] -= amount
    # Only what changed between the drawn state and the last one is moved.
    moves: list[tuple[str, str | None, str, int]] = []
    for c, cats in can.items():
        less = [[t, drawn.get((c, t), 0) - use.get((c, t), 0)] for t in cats if drawn.get((c, t), 0) > use.get((c, t), 0)]
        less.append([None, free.get(c, 0) - spare.get(c, 0)])
        for t in cats:
            need = use.get((c, t), 0) - drawn.get((c, t), 0)
            for x in less:
                k = min(need, x[1])
                if k > 0:
                    moves.append((c, x[0], t, k))
                    x[1] -= k
                    need -= k
        moves += [(c, t, None, k) for t, k in less[:-1] if k > 0]
    return have, moves


def pool(keys: DataFrame, id_: str = "source_id", group: str = "campaign", stratum: str = "stratum", margins: tuple[str, ...] = ("path",)) -> DataFrame:
    """(grp, id, strata, margins...): each record once, with all categories it is in, sorted. Records without id, category or
    group are none; a record of several values of another margin has the least, a null is an empty one."""
    rows = keys.select(F.col(group).alias("grp"), category(F.col(stratum)).alias("s"), F.col(id_).alias("id"), *(F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"m{i}") for i, m in enumerate(margins)))
    by = rows.filter("id IS NOT NULL AND s IS NOT NULL AND grp IS NOT NULL").groupBy("grp", "id")
    return by.agg(F.array_sort(F.collect_set("s")).alias("strata"), *(F.min(f"m{i}").alias(f"m{i}") for i in range(len(margins))))


def wanted(targets: DataFrame) -> DataFrame:
    """(draw_id, grp, said, stratum, share, min_rows, wanted): wanted is the greater of the minimum and the share of the sample's
    size rounded to a whole number. Null shares and minimums count as 0."""
    share, least = F.coalesce("target_share", F.lit(0.0)), F.coalesce("min_rows", F.lit(0))
    goal = F.greatest(least.cast("bigint"), F.round(share * F.coalesce("sample_size", F.lit(0))).cast("bigint"))
    return targets.select("draw_id", F.col("campaign").alias("grp"), F.col("stratum").alias("said"), category(F.col("stratum")).alias("stratum"), share.alias("share"), least.alias("min_rows"), goal.alias("wanted")).distinct()


_SEP = "\x1f"


def _cell(n_margins: int) -> Column:
    return F.concat_ws(_SEP, F.array_join("strata", ","), *(F.col(f"m{i}") for i in range(n_margins)))


def _draws(cells: DataFrame, goals: DataFrame, shares: DataFrame | None) -> DataFrame:
    """One row per draw: its cells (cell, strata, margins, n), its goals (stratum, wanted) and the target shares of its other
    margins (margin, value, share). All are as many as categories multiply to, never as many as records."""
    c = cells.groupBy("grp").agg(F.collect_list(F.struct("cell", "strata", "margins", "n")).alias("cells"))
    g = goals.groupBy("draw_id", "grp", "stratum").agg(F.max("wanted").alias("wanted")).groupBy("draw_id", "grp").agg(F.array_sort(F.collect_list(F.struct("stratum", "wanted"))).alias("goals"))
    out = g.join(c, "grp", "left")
    if shares is None:
        return out.withColumn("shares", F.array().cast("array<struct<margin:int,value:string,share:double>>"))
    s = shares.groupBy("draw_id").agg(F.collect_list(F.struct(F.col("margin").cast("int").alias("margin"), F.col("value").cast("string").alias("value"), F.col("share").cast("double").alias("share"))).alias("shares"))
    return out.join(s, "draw_id", "left")


def weights(draws: DataFrame) -> DataFrame:
    """(draw_id, grp, cell, options): per cell an array of (stratum, weight, wanted, available), one for each category that its
    records may be drawn for.

    Margins: the categories' goals are ``wanted``, at most what there is; every other margin's are its target shares of the
    same total, by default its shares of the draw's pool. Target values that the pool lacks take no part.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for d, grp, cells, goals, shares in zip(part["draw_id"], part["grp"], part["cells"], part["goals"], part["shares"], strict=True):
                want = {g["stratum"]: int(g["wanted"]) for g in goals}
                options = [(c, s) for c in ([] if cells is None else sorted(cells, key=lambda x: x["cell"])) for s in c["strata"] if s in want]
                if not options:
                    continue
                n = np.array([c["n"] for c, _ in options], float)
                names, codes = np.unique([s for _, s in options], return_inverse=True)
                available = np.bincount(codes, n)
                goal = np.minimum([want[s] for s in names], available)
                margins = []
                for i in range(len(options[0][0]["margins"])):
                    values, m = np.unique([c["margins"][i] for c, _ in options], return_inverse=True)
                    told = {x["value"]: x["share"] for x in ([] if shares is None else shares) if x["margin"] == i}
                    share = np.array([told.get(v, 0.0) for v in values]) if told else np.bincount(m, n)
                    margins.append((m, goal.sum() * share / max(share.sum(), 1e-300)))
                fitted = rake(n, [*margins, (codes, goal)])  # the categories last: their goals are met exactly
                weight = fitted / n
                by: dict[str, list] = {}
                for (c, s), w, k in zip(options, weight, codes, strict=True):
                    by.setdefault(c["cell"], []).append({"stratum": s, "weight": float(w), "wanted": want[s], "available": int(available[k])})
                rows += [(d, grp, c, o) for c, o in by.items()]
            yield pd.DataFrame(rows, columns=["draw_id", "grp", "cell", "options"])

    return draws.mapInPandas(run, "draw_id string, grp string, cell string, options array<struct<stratum:string,weight:double,wanted:bigint,available:bigint>>")


def _repaired(draws: DataFrame, state: DataFrame) -> DataFrame:
    """(draw_id, taken, moves): per draw the records drawn per category after repair, and the moves that lead there, from the
    counts (draw_id, cell, stratum, n) of records drawn."""
    s = state.groupBy("draw_id").agg(F.collect_list(F.struct("cell", "stratum", "n")).alias("state"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for d, cells, goals, state_ in zip(part["draw_id"], part["cells"], part["goals"], part["state"], strict=True):
                cells = [] if cells is None else sorted(cells, key=lambda x: x["cell"])
                want = {g["stratum"]: int(g["wanted"]) for g in goals}
                can = {c["cell"]: [s for s in c["strata"] if s in want] for c in cells}
                drawn = {(x["cell"], x["stratum"]): int(x["n"]) for x in ([] if state_ is None else state_)}
                free = {c["cell"]: int(c["n"]) for c in cells}
                available = dict.fromkeys(want, 0)
                for c in cells:
                    for t in can[c["cell"]]:
                        available[t] += int(c["n"])
                for (c, _), n in drawn.items():
                    free[c] -= n
                have, moves = repair(free, drawn, can, want, sorted(want, key=lambda t: (available[t], t)))
                rows.append((d, [{"stratum": t, "taken": k, "available": available[t]} for t, k in have.items()], [{"cell": c, "source": a, "to": b, "k": k} for c, a, b, k in moves]))
            yield pd.DataFrame(rows, columns=["draw_id", "taken", "moves"])

    return draws.join(s, "draw_id", "left").mapInPandas(run, "draw_id string, taken array<struct<stratum:string,taken:bigint,available:bigint>>, moves array<struct<cell:string,source:string,to:string,k:bigint>>")


def _least(rows: DataFrame, by: list[str], key: str, most: str, size: str) -> DataFrame:
    """The rows of the least keys of each group, as many as its ``most``, ranked as ``r``. A group of more than ``PART_ROWS`` rows (by ``size``) is cut
    part by part first, so that no task sorts a whole group."""
    part = F.pmod(F.hash("id"), F.ceil(F.col(size) / PART_ROWS).cast("int"))
    r = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(key, "id"))
    rows = rows.withColumn("_part", part).withColumn("r", r).filter(F.col("r") <= F.col(most))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(key, "id"))).filter(F.col("r") <= F.col(most)).drop("_part")


class Draws:
    """The draws of ``targets`` over the pool of ``keys``. Their tables are written out as they are needed, once.

    ``margins`` are columns of ``keys`` besides the categories; ``shares`` (draw_id, margin, value, share) their target shares
    by the margin's place, by default the shares of the draw's pool.
    """

    def __init__(self, keys: DataFrame, targets: DataFrame, margins: tuple[str, ...] = ("path",), shares: DataFrame | None = None):
        self.goals = materialize(wanted(targets), "p3-goals")
        own = small(self.goals.select("grp").distinct())
        n = len(margins)
        self.pool = materialize(pool(keys.join(own, keys["campaign"] == own["grp"], "left_semi"), margins=margins).withColumn("cell", _cell(n)), "p3-pool")
        values = F.array(*(F.col(f"m{i}") for i in range(n))) if n else F.array().cast("array<string>")
        cells = self.pool.groupBy("grp", "cell", "strata", values.alias("margins")).agg(F.count("*").alias("n"))
        self.draws = materialize(_draws(cells, self.goals, shares), "p3-draws")
        w = materialize(weights(self.draws), "p3-weights")
        rows = self.pool.select("grp", "id", "cell").join(small(w), ["grp", "cell"])
        u = 1 - unit_hash(F.col("draw_id"), F.col("id"))
        # One key per category: a hash of draw, id and category; the least of them decides. Without weight there is no key.
        never = F.lit(float("inf"))
        keyed = F.transform("options", lambda o: F.struct(F.coalesce(F.try_divide(-F.log(1 - unit_hash(F.col("draw_id"), F.col("id"), o["stratum"])), o["weight"]), never).alias("key"), o["stratum"].alias("stratum"), o["wanted"].alias("wanted"), o["available"].alias("available")))
        one = F.struct(F.coalesce(F.try_divide(-F.log(u), F.col("options")[0]["weight"]), never).alias("key"), F.col("options")[0]["stratum"].alias("stratum"), F.col("options")[0]["wanted"].alias("wanted"), F.col("options")[0]["available"].alias("available"))
        rows = rows.withColumn("o", F.when(F.size("options") == 1, one).otherwise(F.array_min(keyed)))
        rows = rows.select("draw_id", "cell", "id", "o.*").filter((F.col("key") < never) & (F.col("wanted") > 0))
        self.drawn = materialize(_least(rows, ["draw_id", "stratum"], "key", "wanted", "available").select("draw_id", "cell", "id", "stratum", "key"), "p3-drawn")
        state = self.drawn.groupBy("draw_id", "cell", "stratum").agg(F.count("*").alias("n"))
        self.repaired = materialize(_repaired(self.draws, state), "p3-repaired")

    def sample(self) -> DataFrame:
        """(draw_id, stratum, id) of the records drawn, after repair."""
        moves = self.repaired.select("draw_id", F.explode("moves").alias("m")).select("draw_id", "m.*")
        w = Window.partitionBy("draw_id", "cell", "source").orderBy("to")
        moves = small(moves.withColumn("upto", F.sum("k").over(w)).withColumn("total", F.sum("k").over(Window.partitionBy("draw_id", "cell", "source"))))
        need = moves.select("draw_id", "cell", "source", "total").distinct()
        grp = self.draws.select("draw_id", "grp")
        undrawn = need.filter("source IS NULL").join(grp, "draw_id").join(self.pool.select("grp", "cell", "id"), ["grp", "cell"]).join(self.drawn.select("draw_id", "id"), ["draw_id", "id"], "left_anti")
        undrawn = undrawn.select("draw_id", "cell", "id", F.lit(None).cast("string").alias("source"), "total", (-F.log(1 - unit_hash(F.col("draw_id"), F.col("id")))).alias("key"))
        taken = self.drawn.withColumnRenamed("stratum", "source").join(need.filter("source IS NOT NULL"), ["draw_id", "cell", "source"]).select("draw_id", "cell", "id", "source", "total", "key")
        # Undrawn records join by their least keys, drawn ones leave by their greatest.
        cand = materialize(undrawn.unionByName(taken.withColumn("key", -F.col("key"))), "p3-candidates")
        n = cand.groupBy(F.col("draw_id").alias("_d"), F.col("cell").alias("_c"), F.col("source").alias("_s")).agg(F.count("*").alias("size"))
        cand = cand.join(n, (F.col("draw_id") == F.col("_d")) & (F.col("cell") == F.col("_c")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_d", "_c", "_s")
        movers = _least(cand, ["draw_id", "cell", "source"], "key", "total", "size").select("draw_id", "cell", "source", "id", "r")
        m = moves.select(F.col("draw_id").alias("_d"), F.col("cell").alias("_c"), F.col("source").alias("_s"), "to", "upto", "k")
        moved = movers.join(m, (F.col("draw_id") == F.col("_d")) & (F.col("cell") == F.col("_c")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - F.col("k")))
        moved = materialize(moved.select("draw_id", F.col("to").alias("stratum"), "id"), "p3-moved")
        stay = self.drawn.select("draw_id", "stratum", "id").join(moved.select("draw_id", "id"), ["draw_id", "id"], "left_anti").select("draw_id", "stratum", "id")
        return stay.unionByName(moved.filter("stratum IS NOT NULL"))

    def report(self) -> DataFrame:
        """One row per draw and category: wanted, available and taken records, what of the sample they make up, and two gaps.

        ``residual_gap`` is what the repaired sample lacks; ``gap`` how many of those records the pool doesn't have at all,
        which is less where categories share records.
        """
        t = self.repaired.select("draw_id", F.explode("taken").alias("t")).select("draw_id", "t.*")
        share = F.try_divide(F.col("taken").cast("double"), F.sum("taken").over(Window.partitionBy("draw_id")))
        out = self.goals.join(t, ["draw_id", "stratum"])
        return out.select(
            "draw_id", F.col("said").alias("stratum"), "share", share.alias("share_taken"), "min_rows", "wanted", "available", "taken",
            F.greatest(F.col("wanted") - F.col("available"), F.lit(0)).alias("gap"), F.greatest(F.col("wanted") - F.col("taken"), F.lit(0)).alias("residual_gap"),
        )


def draw(keys: DataFrame, targets: DataFrame, **more) -> DataFrame:
    """(draw_id, stratum, id) of every draw; see ``Draws``."""
    return Draws(keys, targets, **more).sample()


def report(keys: DataFrame, targets: DataFrame, **more) -> DataFrame:
    return Draws(keys, targets, **more).report()


def running_weights(df: DataFrame, id_: str, wave: str, weight: Column) -> DataFrame:
    """(id, wave, weight): the largest weight a record had up to each wave in which it has rows.

    Rows without id, wave or weight are none; of several rows of one record and wave the largest weight counts.
    """
    rows = df.select(F.col(id_).alias("id"), F.col(wave).alias("wave"), weight.cast("double").alias("w")).filter("id IS NOT NULL AND wave IS NOT NULL AND w IS NOT NULL")
    rows = rows.groupBy("id", "wave").agg(F.max("w").alias("w"))
    upto = Window.partitionBy("id").orderBy("wave").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("id", "wave", F.max("w").over(upto).alias("weight"))


def poisson(weighted: DataFrame, seed: Column, constant: float) -> DataFrame:
    """The rows whose record's hash under ``seed`` is below its running weight times ``constant``, with that hash as ``u``.

    The test reads nothing but the row, so the sample doesn't depend on other records: it grows as they come.
    """
    return weighted.withColumn("u", unit_hash(seed, F.col("id"))).filter(F.col("u") < F.col("weight") * constant)
