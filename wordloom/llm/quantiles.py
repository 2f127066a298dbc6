"""p6: percentiles of numeric columns from relative-rank compactor sketches that can be merged.

A sketch keeps values in levels; a value of level h stands for 2**h. When a level is full, part of its low values is
sorted and every second one moves up, the high values stay: the rank error is a small multiple of the distance to the
top, so that extreme percentiles stay sharp. How much of a level is compacted follows the trailing ones of the number
of compactions it has seen. Sketches of shards, days or partitions merge into that of their union.

Every partition sketches what it reads, so only sketches are shuffled; where repeats of an id must count once, the ids
are made unique before. Whole numbers stay whole, other numbers stay as they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import small

#: Section size of a new level. With 32 the rank error is far below one percentage point anywhere.
SECTION = 32
#: Values that a task holds in sketches before it passes them on and begins new ones.
HELD = 4_000_000
#: Partitions whose sketches of a group are merged at a time.
FAN = 64
_WHOLE = ("tinyint", "smallint", "int", "bigint")


class Sketch:
    """Relative-rank compactors over numbers of one kind (64-bit integers or doubles), high ranks exact."""

    def __init__(self, section: int = SECTION, kind: type = np.int64):
        self.n = 0
        self.kind = np.dtype(kind)
        self.levels: list[np.ndarray] = []
        self.meta: list[list[int]] = []  # section size, sections, compactions of each level
        self.section = section

    def _level(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.empty(0, self.kind))
            self.meta.append([self.section, 3, 0])

    def add(self, values: np.ndarray) -> None:
        self._level(0)
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values.astype(self.kind)])
        self._compress()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        if other.levels:
            self._level(len(other.levels) - 1)
        for h, (values, (size, sections, seen)) in enumerate(zip(other.levels, other.meta, strict=True)):
            mine = self.meta[h]
            self.levels[h] = np.concatenate([self.levels[h], values])
            if sections > mine[1]:
                mine[0], mine[1] = size, sections
            mine[2] |= seen
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            size, sections, seen = self.meta[h]
            room = 2 * size * sections
            if len(self.levels[h]) >= room:
                ones = (seen ^ (seen + 1)).bit_length() - 1  # trailing ones
                keep = room // 2 + (sections - min(ones + 1, sections)) * size
                values = np.sort(self.levels[h])
                cut = len(values) - keep
                cut -= cut & 1
                # Which half moves up is a fixed coin of level and count, turned over every other time.
                coin = (((h + 1) * 0x9E3779B97F4A7C15 + (seen >> 1) * 0xBF58476D1CE4E5B9) >> 17 ^ seen) & 1
                self._level(h + 1)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[coin:cut:2]])
                self.levels[h] = values[cut:]
                self.meta[h][2] = seen + 1
                if seen + 1 >= 1 << (sections - 1):
                    smaller = max(4, int(size / 2**0.5) & ~1)
                    if smaller >= 4 and size > 4:
                        self.meta[h][0], self.meta[h][1] = smaller, sections * 2
            h += 1

    def quantiles(self, qs: list[float]) -> list[int | None]:
        """The value at each share q of the ranks: the least whose weighted rank reaches q * n; None of an empty sketch."""
        if not self.n:
            return [None] * len(qs)
        values = np.concatenate(self.levels)
        weights = np.repeat(1 << np.arange(len(self.levels), dtype=np.int64), [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.asarray(qs) * ranks[-1] - 1e-9, side="left")
        return values[order][np.minimum(at, len(values) - 1)].tolist()

    def dump(self) -> bytes:
        head = struct.pack("<qii?", self.n, self.section, len(self.levels), self.kind == np.float64)
        per = b"".join(struct.pack("<iiiq", len(v), m[0], m[1], m[2]) for v, m in zip(self.levels, self.meta, strict=True))
        return head + per + b"".join(v.tobytes() for v in self.levels)

    @classmethod
    def load(cls, data: bytes) -> Sketch:
        n, section, levels, real = struct.unpack_from("<qii?", data)
        out, at = cls(section, np.float64 if real else np.int64), struct.calcsize("<qii?")
        out.n = n
        step = struct.calcsize("<iiiq")
        body = at + levels * step
        for h in range(levels):
            count, size, sections, seen = struct.unpack_from("<iiiq", data, at + h * step)
            out.levels.append(np.frombuffer(data, out.kind, count, body))
            out.meta.append([size, sections, seen])
            body += 8 * count
        return out


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def sketches(df: DataFrame, groups: list[str], value: str, once: str | None = None, section: int = SECTION) -> DataFrame:
    """(groups..., part, n, sketch): for each group a sketch of every partition that has values of it, together all values;
    ``part`` is the partition.

    Null values, and values that are no number, take no part; null group columns are a group. With ``once`` rows repeated
    under that id in one group count once, with the least value, and only they are shuffled, by group and id: no group, however large, is
    one task's. A task holds a bounded number of values, and begins new sketches when it has reached it. Which values
    meet in a sketch follows the partitions, so percentiles of large groups may differ within the error.
    """
    whole = df.schema[value].dataType.simpleString() in _WHOLE
    rows = df.select(*groups, *([once] if once else []), F.col(value).cast("bigint" if whole else "double").alias("_v")).filter("_v IS NOT NULL" if whole else "_v IS NOT NULL AND NOT isnan(_v)")
    if once:
        rows = rows.groupBy(*groups, once).agg(F.min("_v").alias("_v"))
    rows = rows.select(*groups, F.spark_partition_id().alias("part"), "_v")
    width, kind = len(groups), np.int64 if whole else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        waiting: dict[tuple, list[np.ndarray]] = {}
        size, schema, part = 0, None, 0

        def flush():
            for key, parts in waiting.items():
                held.setdefault(key, Sketch(section, kind)).add(np.concatenate(parts))
            waiting.clear()

        def out():
            cols = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(width)]
            cols += [pa.array([part] * len(held), pa.int32()), pa.array([s.n for s in held.values()], pa.int64()), pa.array([s.dump() for s in held.values()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*groups, "part", "n", "sketch"])

        pending = 0
        for b in batches:
            if not len(b):
                continue
            schema, part = b.schema, b.column(width)[0].as_py()
            values = b.column(width + 1).to_numpy(zero_copy_only=False)
            # Each distinct key of the batch once, and the rows' codes into them.
            codes, keys = np.zeros(len(b), np.int64), [()]
            for i in range(width):
                d = b.column(i).dictionary_encode(null_encoding="encode")
                words = d.dictionary.to_pylist()
                codes = codes * len(words) + d.indices.to_numpy(zero_copy_only=False)
                used, codes = np.unique(codes, return_inverse=True)
                keys = [(*keys[u // len(words)], words[u % len(words)]) for u in used.tolist()]
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for key, piece in zip(keys, np.split(values[order], cuts), strict=True):
                waiting.setdefault(key, []).append(piece)
            pending += len(b)
            if pending >= HELD // 4:
                flush()
                pending = 0
                size = sum(sum(map(len, s.levels)) for s in held.values())
                if size >= HELD:
                    yield out()
        flush()
        if held:
            yield out()

    return rows.mapInArrow(run, f"{_kinds(rows, groups)}part int, n bigint, sketch binary")


def merged(sketched: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., part, n, sketch): one sketch per group (``part`` 0), from any number of its parts. Parts are merged by the
    dozens first, so that no task loads all sketches of a group."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for first, *rest in p["sketch"]:  # in a fixed order, so that the same parts give the same result
                if rest:
                    total = Sketch.load(first)
                    for data in rest:
                        total.merge(Sketch.load(data))
                    first = total.dump()
                out.append(first)
            yield p.assign(sketch=out)

    def step(df: DataFrame, part: Column) -> DataFrame:
        lists = df.withColumn("part", part).groupBy(*groups, "part").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("sketch")).alias("sketch"))
        return lists.mapInPandas(run, f"{_kinds(sketched, groups)}part int, n bigint, sketch binary")

    return step(step(sketched, F.floor(F.col("part") / FAN).cast("int")), F.lit(0))


def percentiles(sketched: DataFrame, groups: list[str], qs: list[int]) -> DataFrame:
    """(groups..., n, q, value): percentiles ``qs`` (0 to 100) of each group's sketch, as doubles."""
    shares = [q / 100 for q in qs]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = p[[*groups, "n"]].loc[p.index.repeat(len(qs))].reset_index(drop=True)
            values = [v for s in p["sketch"] for v in Sketch.load(s).quantiles(shares)]
            yield out.assign(q=np.tile(np.asarray(qs, np.int32), len(p)), value=np.array(values, float))

    return sketched.mapInPandas(run, f"{_kinds(sketched, groups)}n bigint, q int, value double")


def over_limits(found: DataFrame, limits: DataFrame) -> DataFrame:
    """Percentiles (..., q, value) that exceed the limit of their q in ``limits`` (q, limit_ms)."""
    return found.join(small(limits.select("q", "limit_ms").distinct()), "q").filter("value > limit_ms")
