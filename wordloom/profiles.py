"""Language profiles: what an operator needs to know about a script, as plain values."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product


def _prefixes(*slots: tuple[str, ...]) -> tuple[str, ...]:
    """Every non-empty combination of one item per slot, longest first, then in code-point order."""
    found = {"".join(p) for p in product(*slots)} - {""}
    return tuple(sorted(found, key=lambda p: (-len(p), p)))


@dataclass(frozen=True)
class Profile:
    """Letters are a regex class body; rows are the keyboard's letter rows from left to right."""

    name: str
    letters: str
    alphabet: str
    points: str
    prefixes: tuple[str, ...]
    confusions: tuple[tuple[str, str], ...]
    vowels: tuple[str, str]
    finals: tuple[tuple[str, str], ...]
    rows: tuple[str, ...]
    #: Width, in keys, of a non-letter key at either end of a row.
    row_ends: tuple[tuple[float, float], ...]
    #: Fixed value: what ends a sentence.
    boundary: str = r"[.!?;:\n׃]|--"

    @property
    def run(self) -> str:
        return f"[{self.letters}]+"


# Fixed values of the Hebrew profile.
HEBREW = Profile(
    name="he",
    letters="א-ת",
    alphabet="אבגדהוזחטיךכלםמןנסעףפץצקרשת",
    points="֑-ׇ",
    prefixes=_prefixes(("", "ו"), ("", "ש", "כש", "מש"), ("", "ב", "כ", "ל", "מ"), ("", "ה")),
    confusions=(("א", "ע"), ("ח", "כ"), ("כ", "ק"), ("ת", "ט"), ("ב", "ו"), ("ס", "ש")),
    vowels=("ו", "י"),
    finals=(("כ", "ך"), ("מ", "ם"), ("נ", "ן"), ("פ", "ף"), ("צ", "ץ")),
    rows=("קראטוןםפ", "שדגכעיחלךף", "זסבהנמצתץ"),
    row_ends=((0.0, 0.0), (0.0, 0.0), (1.5, 1.5)),
)
# Fixed values of the Latin profile; confusions are of this library's own choice.
LATIN = Profile(
    name="la",
    letters="a-z",
    alphabet="abcdefghijklmnopqrstuvwxyz",
    points="̀-ͯ",
    prefixes=(),
    confusions=(("b", "v"), ("c", "k"), ("s", "z"), ("y", "i")),
    vowels=("e", "a"),
    finals=(),
    rows=("qwertyuiop", "asdfghjkl", "zxcvbnm"),
    row_ends=((0.0, 0.0), (0.0, 0.0), (1.5, 1.5)),
)

#: Default parameters of the models.
MIN_COUNT, MIN_ABBREVIATION, BLEND = 5, 10, 0.25
MIN_STEM, SEGMENT_STEM = 4, 2
UNIT, MAX_EDITS, MIN_TYPED, SUGGESTIONS = 100, 2, 3, 3
COMPLETION_CANDIDATES, NEXT_CANDIDATES = 24, 16
BIGRAM_WEIGHT, USER_WEIGHT, USER_CAP = 2.0, 2.0, 32
DETECT_MARGIN, PRIOR_MARGIN = 21, 104
MIN_SESSIONS, USER_CAPACITY, RETAIN = 2, 40_000, 0.9
BUFFER = 2048
WORD_END = "</w>"
