"""Visual order of a line under either paragraph direction: the implicit part of the bidirectional algorithm, with isolates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MIRROR = str.maketrans("()[]{}<>", ")(][}{><")
_ISOLATES = "⁦⁧⁨"
_END = "⁩"


def _levels(kinds: list[str], base: int) -> list[int]:
    """Levels of characters by their classes: weak types, then neutrals, then implicit levels."""
    edge = "R" if base else "L"
    k = list(kinds)
    last = edge
    for i, c in enumerate(k):  # marks take their base's class, numbers after Arabic letters are Arabic numbers
        if c == "NSM":
            k[i] = k[i - 1] if i else edge
        elif c == "EN" and last == "AL":
            k[i] = "AN"
        if k[i] in ("L", "R", "AL"):
            last = k[i]
    k = ["R" if c == "AL" else c for c in k]
    for i in range(1, len(k) - 1):  # separators within numbers
        if k[i] in ("ES", "CS") and k[i - 1] == k[i + 1] == "EN" or k[i] == "CS" and k[i - 1] == k[i + 1] == "AN":
            k[i] = k[i - 1]
    i = 0
    while i < len(k):  # terminators beside numbers
        if k[i] == "ET":
            j = i
            while j < len(k) and k[j] == "ET":
                j += 1
            if (i and k[i - 1] == "EN") or (j < len(k) and k[j] == "EN"):
                k[i:j] = ["EN"] * (j - i)
            i = j
        else:
            i += 1
    last = edge
    for i, c in enumerate(k):  # numbers after Latin letters are part of them
        if c in ("L", "R"):
            last = c
        elif c == "EN" and last == "L":
            k[i] = "L"
    strong = {"L": "L", "R": "R", "EN": "R", "AN": "R"}
    i = 0
    while i < len(k):
        if k[i] in strong:
            i += 1
            continue
        j = i
        while j < len(k) and k[j] not in strong:
            j += 1
        a, b = strong[k[i - 1]] if i else edge, strong[k[j]] if j < len(k) else edge
        k[i:j] = [a if a == b else edge] * (j - i)
        i = j
    up = {"L": (0, 1), "R": (1, 0), "EN": (2, 1), "AN": (2, 1)}
    return [base + up[c][base % 2] for c in k]


def reorder(line: str, base: int) -> str:
    """The line as it is drawn from left to right; isolated runs are laid out on their own, their marks left out."""
    parts: list[str] = []
    kinds: list[str] = []
    i = 0
    while i < len(line):
        if line[i] in _ISOLATES:
            depth, j = 1, i + 1
            while j < len(line) and depth:
                depth += (line[j] in _ISOLATES) - (line[j] == _END)
                j += 1
            inner = line[i + 1 : j - 1 if not depth else j]
            first = next((unicodedata.bidirectional(c) for c in inner if unicodedata.bidirectional(c) in ("L", "R", "AL")), "L")
            way = base if line[i] == "⁨" and not inner else {"⁦": 0, "⁧": 1}.get(line[i], int(first != "L"))
            parts.append(reorder(inner, way))
            kinds.append("ON")
            i = j
        elif line[i] == _END:
            i += 1
        else:
            parts.append(line[i])
            kinds.append(unicodedata.bidirectional(line[i]) or "ON")
            i += 1
    levels = _levels(kinds, base)
    cells = [p.translate(_MIRROR) if len(p) == 1 and lv % 2 else p for p, lv in zip(parts, levels, strict=True)]
    for at in range(max(levels, default=0), 0, -1):
        i = 0
        while i < len(cells):
            if levels[i] >= at:
                j = i
                while j < len(cells) and levels[j] >= at:
                    j += 1
                cells[i:j] = cells[i:j][::-1]
                levels[i:j] = levels[i:j][::-1]
                i = j
            else:
                i += 1
    return "".join(cells)


@F.pandas_udf(T.StringType())
def visual(lines: pd.Series, base: pd.Series) -> pd.Series:
    """Visual order; lines of one direction are settled without the algorithm's later steps. Null gives null."""
    return pd.Series([None if t is None else reorder(t, int(b)) for t, b in zip(lines, base, strict=True)], dtype=object)
