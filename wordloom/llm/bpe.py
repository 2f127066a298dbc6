"""p7: encoding with a public byte-level BPE tokenizer, and decoding.

Pre-tokenisation is vectorised over all texts of an Arrow batch at once: the codepoints become symbols through a class
table, an automaton's transition functions are composed over blocks of the symbols (composition is associative, so the
blocks are scanned side by side), and the states found say where a piece begins. No regular expression is involved.
The pieces between the boundaries are looked up in a cache, which merges those it doesn't have.

The automaton is that of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|blanks not followed by a non-blank|blanks
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' files; a parameter everywhere.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"

# Symbols of the automaton. A blank's symbol says what follows it, an apostrophe's whether a contraction begins there.
LETTER, DIGIT, OTHER, SPACE_GLUED, BLANK_LAST, BLANK_MID, APOS_1, APOS_2, END = range(9)
# States: what the piece that the last codepoint belongs to can still take in.
NONE, IN_LETTERS, IN_DIGITS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, NEED_1, NEED_2 = range(8)
#: Codepoints per scan block, and per call, which bounds the memory that a batch of long texts takes.
BLOCK, MOST = 256, 1 << 22


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each codepoint: LETTER, DIGIT (any number), OTHER, or BLANK_MID for white space."""
    kind = {"L": LETTER, "N": DIGIT}
    t = np.full(0x110000, OTHER, np.uint8)
    for o in range(0x110000):
        k = kind.get(unicodedata.category(chr(o))[0])
        if k is not None:
            t[o] = k
    # Unicode's White_Space.
    t[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK_MID
    return t


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by symbol and state."""
    to, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    alone = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHERS, SPACE_GLUED: AFTER_SPACE, BLANK_LAST: NONE, BLANK_MID: IN_BLANKS, APOS_1: NEED_1, APOS_2: NEED_2, END: NONE}
    for symbol, state in alone.items():
        to[symbol, :] = state
    for symbol, state, then in [
        (LETTER, IN_LETTERS, IN_LETTERS), (DIGIT, IN_DIGITS, IN_DIGITS), (OTHER, IN_OTHERS, IN_OTHERS), (BLANK_MID, IN_BLANKS, IN_BLANKS),
        (APOS_1, IN_OTHERS, IN_OTHERS), (APOS_2, IN_OTHERS, IN_OTHERS), (LETTER, AFTER_SPACE, IN_LETTERS), (DIGIT, AFTER_SPACE, IN_DIGITS),
        (OTHER, AFTER_SPACE, IN_OTHERS), (APOS_1, AFTER_SPACE, IN_OTHERS), (APOS_2, AFTER_SPACE, IN_OTHERS), (LETTER, NEED_1, NONE), (LETTER, NEED_2, NEED_1),
    ]:
        to[symbol, state], begins[symbol, state] = then, False
    return to, begins


def symbols(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of the codepoints; ``ends`` are the positions of the separators between texts."""
    s = classes()[cp]
    s[ends] = END
    blank = s == BLANK_MID
    follows = np.empty_like(blank)
    follows[:-1] = (s[1:] != BLANK_MID) & (s[1:] != END)
    follows[-1] = False
    last = blank & follows
    s[last] = BLANK_LAST
    s[last & (cp == 32)] = SPACE_GLUED
    at = np.flatnonzero(cp == 39)
    if len(at):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        one, two = pad[at + 1], pad[at + 2]
        s[at[np.isin(one, [ord(c) for c in "stmd"])]] = APOS_1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        s[at[pair]] = APOS_2
    return s


def scan(s: np.ndarray) -> np.ndarray:
    """State before each symbol, from NONE, by composing transition functions.

    Each block's functions are composed step by step for all blocks and all starting states at once; the blocks'
    functions then chain, which gives the state that each block starts from.
    """
    to, _ = automaton()
    n = len(s)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.uint8)
    grid[:n] = s
    grid = grid.reshape(rows, BLOCK)
    f = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    before = np.empty((BLOCK, rows, 8), np.uint8)
    for j in range(BLOCK):
        before[j] = f
        f = to[grid[:, j, None], f]
    start = np.empty(rows, np.uint8)
    state = NONE
    for i, g in enumerate(f.tolist()):
        start[i] = state
        state = g[state]
    return np.take_along_axis(before, start[None, :, None].astype(np.intp), 2)[:, :, 0].T.reshape(-1)[:n]


def boundaries(text: str, ends: np.ndarray) -> np.ndarray:
    """Positions in ``text`` where a piece or a separator begins."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols(cp, ends)
    _, begins = automaton()
    return np.flatnonzero(begins[s, scan(s)])


@lru_cache(maxsize=4)
def ranks(name: str, folder: str) -> dict[bytes, int]:
    """Token bytes -> id, which is also the rank of the merge that makes it."""
    path = os.path.join(folder, f"{name}.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of the lowest rank is merged first, the leftmost of equals. A heap of pairs keeps it
    at n log n for a piece of any length."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 48:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        end[i], alive[j] = stop, False
        if stop < n:
            prev[stop] = i
            if (r := rank.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := rank.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [rank[piece[i : end[i]]] for i in range(n) if alive[i]]


class Pieces(dict):
    """Ids by piece. Pieces of over ``longest`` characters aren't kept; it is emptied beyond ``most`` pieces."""

    def __init__(self, rank: dict[bytes, int], most: int = 400_000, longest: int = 64):
        super().__init__()
        self.rank, self.most, self.longest = rank, most, longest

    def __missing__(self, piece: str):
        ids = merge(piece.encode("utf-8", "replace"), self.rank)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def cache(name: str, folder: str) -> Pieces:
    """The cache of this Python worker."""
    return Pieces(ranks(name, folder))


def encode_texts(texts: list[str], pieces: Pieces, offsets: bool = False) -> tuple[list[int], list[int], list[int]]:
    """(all ids, number of ids of each text, first UTF-8 byte of each token if asked for). Texts mustn't be None."""
    ids: list[int] = []
    counts: list[int] = []
    starts: list[int] = []
    vocabulary = {v: len(k) for k, v in pieces.rank.items()} if offsets else {}
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < MOST):
            size += len(texts[j]) + 1
            j += 1
        text = "\n".join(texts[i:j]) + "\n"
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]]) - 1
        cuts = boundaries(text, ends).tolist()
        cuts.append(len(text))
        k, done = 0, len(ids)
        for e in ends.tolist():
            byte = 0
            while cuts[k] < e:
                got = pieces[text[cuts[k] : cuts[k + 1]]]
                ids += got
                if offsets:
                    for x in got:
                        starts.append(byte)
                        byte += vocabulary[x]
                k += 1
            k += 1  # the separator
            counts.append(len(ids) - done)
            done = len(ids)
        i = j
    return ids, counts, starts


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, offsets: bool = False) -> DataFrame:
    """(key, ids[, starts]) of each row of ``df``, special tokens' strings being ordinary text.

    A null and an empty text have the empty list. ``starts`` are the UTF-8 byte offsets at which the tokens begin.
    Other columns of ``df`` are left out. One narrow Arrow stage: nothing is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = cache(name, folder)
        for b in batches:
            ids, counts, starts = encode_texts([t or "" for t in b.column(1).to_pylist()], pieces, offsets)
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            out = [b.column(0), pa.ListArray.from_arrays(at, pa.array(np.asarray(ids, np.int32)))]
            if offsets:
                out.append(pa.ListArray.from_arrays(at, pa.array(np.asarray(starts, np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=[key, "ids", "starts"][: len(out)])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", starts array<int>" * offsets)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, n_tokens) of each row of ``df``: as ``encode``, but the ids stay where they are made."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = cache(name, folder)
        for b in batches:
            _, counts, _ = encode_texts([t or "" for t in b.column(1).to_pylist()], pieces)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(counts, np.int64))], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, text) of rows of ids; null ids give a null text. An id outside the vocabulary fails the job."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {v: k for k, v in ranks(name, folder).items()}
        for b in batches:
            texts = [None if x is None else b"".join(words[i] for i in x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
