"""p1: one consistent form for text that looks the same but is written with different characters.

Each token's characters are looked up in classes of look-alikes; a class lists at most one spelling per script. The
script sets that the token's classes can be spelt in are intersected: a token whose characters are of several scripts
but share one is mixed-script confusable and takes the spelling of the shared script; a token of one script that could
wholly be spelt in another is whole-script confusable and keeps one fixed script's spelling. In ``normal_form`` a Hebrew
word stays Hebrew and a Latin one Latin even if either could be spelt in the other; ``look_form``, by which records are
compared, spells both in Hebrew. What is left (widths, fonts, ligatures, compositions, order of marks, invisible signs,
kinds of blanks) is normalised.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEBREW, LATIN, CYRILLIC, GREEK, ARMENIAN = "HEBREW", "LATIN", "CYRILLIC", "GREEK", "ARMENIAN"

# Letters of four scripts that are drawn alike, as "Latin other-script" pairs.
GREEK_PAIRS = "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ aα yγ iι vν oο pρ uυ cϲ jϳ"
CYRILLIC_PAIRS = "AА BВ EЕ SЅ IІ JЈ KК MМ HН OО PР CС TТ YҮ XХ GԌ QԚ WԜ aа cс dԁ eе hһ iі jј lӀ oо pр qԛ sѕ vѵ wԝ xх yу"
ARMENIAN_PAIRS = "OՕ SՍ LԼ oօ uս hհ nո gց"
HEBREW_PAIRS = "oס"
#: The Latin small l and its look-alikes are drawn like two Hebrew letters; see ``_hebrew_stroke``.
STROKE, VAV, FINAL_NUN = "l", "ו", "ן"
#: Yiddish letters that stand for two letters but have no decomposition.
LIGATURES = {"װ": "וו", "ױ": "וי", "ײ": "יי"}
#: Signs drawn like an ASCII sign or like each other.
SIGNS = {"׳": "'", "ʹ": "'", "ʼ": "'", "״": '"', "־": "-", "‐": "-", "‑": "-", "׃": ":", "∶": ":", "׀": "|", "∣": "|", "ӏ": "Ӏ", "ǀ": "|"}
#: Tags of compatibility decompositions under which a character is drawn as its parts are.
DRAWN_ALIKE = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<compat>"}
#: Where several scripts could spell a whole token: the first of them that the token has a letter of.
PREFERENCE = (HEBREW, LATIN, CYRILLIC, GREEK, ARMENIAN)


def _classes() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """(character -> class, class -> script -> spelling). A class is named by its Latin spelling."""
    member, spelling = {}, {}
    for script, pairs in ((GREEK, GREEK_PAIRS), (CYRILLIC, CYRILLIC_PAIRS), (ARMENIAN, ARMENIAN_PAIRS), (HEBREW, HEBREW_PAIRS)):
        for latin, other in pairs.split():
            member[latin], member[other] = latin, latin
            spelling.setdefault(latin, {LATIN: latin})[script] = other
    member[VAV] = member[FINAL_NUN] = STROKE
    spelling[STROKE][HEBREW] = VAV
    return member, spelling


CLASS_OF, SPELLINGS = _classes()
#: Hebrew letters that other scripts can spell, and marks: a word of them alone could be of another script.
_ANY_SCRIPT = frozenset([c for c in CLASS_OF if "א" <= c <= "ת"] + [chr(o) for o in range(0x591, 0x5C8)])


@lru_cache(maxsize=1 << 16)
def script_of(ch: str) -> str | None:
    """The script of a letter by its Unicode name; None for what belongs to no script of its own."""
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "")
    return name.split(" ", 1)[0] if name else None


@lru_cache(maxsize=1 << 16)
def invisible(ch: str) -> bool:
    """Signs that aren't drawn: format and control characters, joiners, selectors and fillers; blanks aren't among them."""
    o = ord(ch)
    return (
        (unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace())
        or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= o <= 0x180F
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0000 <= o <= 0xE0FFF
    )


@lru_cache(maxsize=1 << 16)
def parts(ch: str) -> str:
    """A character fully decomposed into those it is drawn as; blanks of any kind become a space, invisible signs nothing."""
    if ch.isspace():
        return " "
    if invisible(ch):
        return ""
    if ch in LIGATURES:
        return LIGATURES[ch]
    tag, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    if not rest or (tag and tag + ">" not in DRAWN_ALIKE):
        return SIGNS.get(ch, ch)
    return "".join(parts(chr(int(x, 16))) for x in rest.split())


class _Parts(dict):
    """``parts`` by codepoint, for str.translate."""

    def __missing__(self, o: int) -> str:
        self[o] = out = parts(chr(o))
        return out


_PARTS = _Parts()


def _tokens(text: str) -> list[str]:
    """Runs of letters, digits and marks, and single other characters, in order."""
    out, run = [], ""
    for ch in text:
        if ch.isalnum() or (run and unicodedata.category(ch)[0] == "M"):
            run += ch
        else:
            if run:
                out.append(run)
                run = ""
            out.append(ch)
    if run:
        out.append(run)
    return out


def _hebrew_stroke(token: str, i: int) -> str:
    """Which Hebrew letter a stroke at ``i`` is: the final nun ends a word; before another letter, or with a point on
    it that only vav carries at a word's end (dagesh, holam), it is vav."""
    j = i + 1
    while j < len(token) and unicodedata.category(token[j])[0] == "M":
        if token[j] in "ֹּ":
            return VAV
        j += 1
    return VAV if j < len(token) and script_of(token[j]) is not None else FINAL_NUN


def _target(own: set[str], shared: frozenset[str], by_look: bool = False) -> str:
    """The script to spell a run in: Hebrew if it has a Hebrew letter, else Latin if that can spell it, else the preferred one.
    ``by_look``: Hebrew wherever that can spell it, so that the script the run is in makes no difference."""
    if HEBREW in shared and (by_look or HEBREW in own):
        return HEBREW
    return next((s for s in (LATIN, *PREFERENCE) if s in shared), min(shared))


def _spell(run: str, after: str, to: str) -> str:
    """``run`` in the letters of the script ``to``; ``after`` is what follows it in its token."""
    out = []
    for i, ch in enumerate(run):
        c = CLASS_OF.get(ch)
        if c is None or script_of(ch) == to or to not in SPELLINGS[c]:
            out.append(ch)
        else:
            out.append(_hebrew_stroke(run + after, i) if c == STROKE and to == HEBREW else SPELLINGS[c][to])
    return "".join(out)


def resolve(token: str, by_look: bool = False) -> tuple[str, bool, bool]:
    """(the token in its consistent script's spelling, mixed-script confusable, whole-script confusable).

    A token no single script can spell is cut into the longest runs, from its start, that one script can. ``by_look``:
    see ``_target``.
    """
    if _POINTED.fullmatch(token) and not _ANY_SCRIPT.issuperset(token):
        return token, False, False
    runs: list[tuple[str, set[str], frozenset[str]]] = []
    for ch in token:
        s = script_of(ch)
        can = frozenset() if s is None else frozenset(SPELLINGS[CLASS_OF[ch]]) if ch in CLASS_OF else frozenset((s,))
        if not runs or (s is not None and runs[-1][2] and not runs[-1][2] & can):
            runs.append((ch, {s} - {None}, can))
        else:
            text, own, shared = runs[-1]
            runs[-1] = (text + ch, own | {s} - {None}, shared if s is None else shared & can if shared else can)
    mixed = any(len(own) > 1 for _, own, _ in runs)
    whole = len(runs) == 1 and len(runs[0][1]) == 1 and len(runs[0][2]) > 1
    rest, out = token, []
    for text, own, shared in runs:
        rest = rest[len(text) :]
        out.append(_spell(text, rest, _target(own, shared, by_look)) if shared else text)
    return "".join(out), mixed, whole


_PLAIN = re.compile(r"[א-ת]+|[!-~]+")
#: Hebrew letters with points and accents: such a word is Hebrew, and its own form once its marks are in order.
_POINTED = re.compile(r"[א-ת][א-ת\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7]*")
#: An ASCII token that Hebrew could spell.
_HEBREW_LIKE = re.compile(r"(?<![0-9A-Za-z])[0-9]*[ol][0-9ol]*(?![0-9A-Za-z])")


def _resolved(text: str, by_look: bool) -> list[tuple[str, bool, bool]]:
    """``resolve`` of each token of a text, in order."""
    bare = text.translate(_PARTS).strip()
    return [resolve(t, by_look) if len(t) > 1 or t.isalpha() else (t, False, False) for t in _tokens(unicodedata.normalize("NFC", bare).translate(_SPLIT))]


def normal_form(text: str | None) -> str | None:
    """The consistent form of a text; a null stays null, invisible signs and blanks at the ends go."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return text
    if _POINTED.fullmatch(text):
        return unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", "".join(t for t, _, _ in _resolved(text, False)))


def look_form(text: str | None) -> str | None:
    """``normal_form``, but a token that Hebrew can spell is spelt in Hebrew whichever script it is in: equal for texts that
    look the same."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text) and not _HEBREW_LIKE.search(text):
        return text
    if _POINTED.fullmatch(text):
        return unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", "".join(t for t, _, _ in _resolved(text, True)))


def flags(text: str | None) -> tuple[bool | None, bool | None]:
    """(has a mixed-script confusable token, has a whole-script confusable one); nulls for a null."""
    if text is None:
        return None, None
    found = _resolved(text, True)
    return any(mixed for _, mixed, _ in found), any(whole for _, _, whole in found)


#: NFC composes Latin, Greek and Cyrillic letters with marks; look-alikes are looked up by base letters, hence this is undone.
_SPLIT: dict[int, str] = {}
for _o in [*range(0xC0, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000)]:
    if (_d := unicodedata.normalize("NFD", chr(_o))) != chr(_o):
        _SPLIT[_o] = _d


class Cache(dict):
    """Forms by word. It is emptied when it grows past a bound, so that a task's memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = form = look_form(word)
        return form


#: Of each Python worker.
_CACHE = Cache()


@F.pandas_udf(T.StringType())
def look_udf(texts: pd.Series) -> pd.Series:
    cache = _CACHE
    return pd.Series([cache[t] if t is None or len(t) < 64 else look_form(t) for t in texts], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("mixed", T.BooleanType()), T.StructField("whole", T.BooleanType())]))
def flags_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([flags(t) for t in texts], columns=["mixed", "whole"], dtype=object)


#: After each word of a list, for a null word and for a null list: codepoints that no text has (what does lose them).
_AFTER, _NULL, _NONE = "\U0010ffff", "\U0010fffe", "\U000fffff"


def look_of_list(text: str) -> list[str]:
    """Look forms of words written one after the other, each with ``_AFTER`` behind it."""
    cache = _CACHE
    return [cache[w] if len(w) < 64 else look_form(w) for w in text.split(_AFTER)[:-1]]


@F.pandas_udf(T.BinaryType())
def list_looks_udf(ordered: pd.Series, unordered: pd.Series) -> pd.Series:
    """Digest of the look of a list of words in order and of one in any order."""
    out = []
    for a, b in zip(ordered, unordered, strict=True):
        words = [*look_of_list(a), _NONE, *sorted(look_of_list(b))]
        out.append(hashlib.md5(_AFTER.join(words).encode("utf-8", "surrogatepass")).digest())
    return pd.Series(out, dtype=object)


def normalized(text: Column) -> Column:
    """Consistent form of a text column, by which texts that look the same are equal."""
    return look_udf(text)


def _joined(words: Column) -> Column:
    """An array of words as one text, nulls told apart."""
    bare = F.transform(words, lambda w: F.concat(F.coalesce(F.translate(w, _AFTER + _NULL + _NONE, ""), F.lit(_NULL)), F.lit(_AFTER)))
    return F.coalesce(F.array_join(bare, ""), F.lit(_NONE + _AFTER))


def fingerprints(df: DataFrame, key: str, look: Column, chars: Column) -> DataFrame:
    """(key, look, chars): 128-bit digests of a record's consistent form and of its characters; one row per distinct three.

    Records without key or text take no part. Only the digests are shuffled from here on, whatever the texts' length.
    """
    return df.select(F.col(key).alias("key"), look.alias("look"), F.unhex(F.md5(chars)).alias("chars")).filter("key IS NOT NULL AND look IS NOT NULL").distinct()


#: Places that the records of one look are spread over before they are paired.
SPOTS = 16


def lookalike_pairs(prints: DataFrame, block: int = 1024) -> DataFrame:
    """Pairs (key_a < key_b) of equal look and unequal characters.

    Only looks that occur with several spellings are paired. A look of many records is split into blocks of ``block``
    records on one side, each of which meets the other side's records in another task, so that no group is held by one
    task; the result is whole.
    """
    groups = prints.groupBy("look").agg(F.min("chars").alias("lo"), F.max("chars").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    blocks = groups.select("look", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int").alias("blocks"))
    # The records of one look meet its row in several places.
    spots = F.explode(F.sequence(F.lit(0), F.lit(SPOTS - 1)))
    several = prints.withColumn("spot", F.pmod(F.hash("key"), F.lit(SPOTS))).join(blocks.withColumn("spot", spots), ["look", "spot"])
    a = several.select("look", F.pmod(F.hash("key"), F.col("blocks")).alias("b"), F.col("key").alias("key_a"), F.col("chars").alias("chars_a"))
    b = several.select("look", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.col("key").alias("key_b"), F.col("chars").alias("chars_b"))
    pairs = a.join(b, ["look", "b"]).filter("key_a < key_b AND chars_a <> chars_b")
    return pairs.select("key_a", "key_b").distinct()


def item_prints(items: DataFrame) -> DataFrame:
    """Fingerprints of labelling items: the words of ``sentence`` in order, the two ``options`` in either order.

    A null sentence or null options count as such: they equal only nulls.
    """
    rows = items.select("id", _joined(F.col("sentence")).alias("s"), _joined(F.array_sort("options")).alias("o"))
    return fingerprints(rows, "id", list_looks_udf("s", "o"), F.concat_ws(f"{_NONE}|{_NONE}", "s", "o"))


def form_prints(forms: DataFrame) -> DataFrame:
    """Fingerprints of verb forms; a null text is none, so such rows take no part."""
    raw = forms.select("form_id", "vocalized_inflection").filter("vocalized_inflection IS NOT NULL")
    return fingerprints(raw, "form_id", F.unhex(F.md5(normalized(F.col("vocalized_inflection")))), F.col("vocalized_inflection"))
