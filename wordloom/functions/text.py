"""Column functions on strings. A null gives a null unless a docstring says otherwise."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.profiles import HEBREW, Profile

GERESH, GERSHAYIM = "׳", "״"
MARKS = "״׳\"'"
#: Unicode's blanks, as a regex class body.
BLANKS = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}"
#: Picture ranges of the character classes.
EMOJI = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}"
#: Character classes in order of precedence, as regex class bodies (white space comes first).
CLASSES = (
    ("hebrew_letter", "א-ת"), ("hebrew_point", r"\x{0591}-\x{05C7}"), ("hebrew_punct", r"\x{05F3}\x{05F4}"),
    ("latin_letter", "A-Za-z"), ("digit", "0-9"), ("bracket", r"()\[\]{}<>"), ("quote", "\"'"), ("ascii_punct", r"\x{21}-\x{7E}"), ("emoji", EMOJI),
)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; the only normalisation without a built-in. Texts that are composed already are passed on."""
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references resolved."""
    return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def strip_points(s: Column, p: Profile = HEBREW) -> Column:
    """Composed, then without the script's points."""
    return F.regexp_replace(nfc(s), f"[{p.points}]", "")


def is_word(s: Column, p: Profile = HEBREW) -> Column:
    """Letters only, at least one."""
    return s.rlike(rf"\A[{p.letters}]+\z")


def is_word_or_abbreviation(s: Column, p: Profile = HEBREW) -> Column:
    """Letters and abbreviation marks, a letter first."""
    return s.rlike(rf"\A[{p.letters}][{p.letters}{MARKS}]*\z")


def strip_marks(s: Column) -> Column:
    return F.translate(s, MARKS, "")


def canonical(s: Column) -> Column:
    """ASCII quotes folded to the script's marks."""
    return F.translate(s, "\"'", GERSHAYIM + GERESH)


def is_phonetic(s: Column) -> Column:
    """Ends in a mark that changes a sound rather than abbreviates."""
    return s.rlike(rf"[גזצת]{GERESH}\z")


#: Fixed value: an abbreviation is one to six letters, a double mark and one to four more, or two to eight and a single mark,
#: with no word character on either side.
ABBREVIATION = r"(?<![\wא-ת])([א-ת]{1,6}[\"״][א-ת]{1,4}|[א-ת]{2,8}['׳])(?![\wא-ת])"


def abbreviations(s: Column) -> Column:
    """Array of the abbreviations in a text, in order."""
    return F.regexp_extract_all(s, F.lit(ABBREVIATION), F.lit(1))


def tokens(s: Column, p: Profile = HEBREW) -> Column:
    """Array of the maximal runs of letters."""
    return F.regexp_extract_all(s, F.lit(f"({p.run})"), F.lit(1))


def sentences(s: Column, p: Profile = HEBREW) -> Column:
    """Array of what lies between sentence boundaries, empty pieces included."""
    return F.split(s, p.boundary, -1)


def token_key(s: Column, p: Profile = HEBREW) -> Column:
    """A text's tokens with single blanks between: equal for texts that differ in anything but letters."""
    return F.array_join(tokens(s, p), " ")


#: Fixed values: (pattern, replacement) of the markup rules before and after the nested templates. Each block tag has a rule of
#: its own, as a rule for all would need a back reference, which not every engine has.
BEFORE = (
    (r"<ref[^>]*/>", " "), (r"(?s)<ref[^>]*>.*?</ref>", " "), (r"(?s)<!--.*?-->", " "),
    *((rf"(?s)<{t}\b.*?</{t}>", " ") for t in ("math", "code", "pre", "syntaxhighlight", "gallery", "timeline")),
)
AFTER = (
    (r"\[\[(?:קובץ|תמונה|File|Image|Category|קטגוריה):[^\]]*\]\]", " "), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"),
    (r"\[https?://\S+\s+([^\]]*)\]", "$1"), (r"https?://\S+", " "), (r"<[^>]+>", " "), (r"(?m)^[*#:;]+", " "), (r"'''|''|=", " "),
)
TEMPLATE, TABLE, NESTING = r"\{\{[^{}]*\}\}", r"\{\|[^{}]*?\|\}", 8


def strip_markup(s: Column, references: bool = True) -> Column:
    """Text of a wiki page without markup; templates and tables are taken out from the inside, up to eight deep. Character
    references are resolved first unless ``references`` is False."""
    if references:
        s = unescape(s)
    for pattern, by in BEFORE:
        s = F.regexp_replace(s, pattern, by)
    inner = s
    for _ in range(NESTING):
        inner = F.regexp_replace(F.regexp_replace(inner, TEMPLATE, " "), TABLE, " ")
    s = F.when(s.contains("{{") | s.contains("{|"), inner).otherwise(s)
    for pattern, by in AFTER:
        s = F.regexp_replace(s, pattern, by)
    return s


def char_class(c: Column) -> Column:
    """Class of one character; every character has exactly one."""
    out = F.when(c.rlike(rf"\A[{BLANKS}]\z"), F.lit("whitespace"))
    for name, body in CLASSES:
        out = out.when(c.rlike(rf"\A[{body}]\z"), F.lit(name))
    return F.when(c.isNotNull(), out.otherwise(F.lit("other")))


#: Classes whose presence in a line is noted.
PRESENCE = (
    ("latin", "[A-Za-z]"), ("digit", "[0-9]"), ("latin_or_digit", "[A-Za-z0-9]"), ("geresh", "[׳״]"), ("ascii_quote", "[\"']"),
    ("bracket", r"[()\[\]{}]"), ("emoji", f"[{EMOJI}]"),
)


#: Kinds of tokens outside the lexicon, in order of precedence.
OOV_KINDS = (
    (f"[{EMOJI}]", "emoji"), (r"\A[0-9]+\z", "digits"), (r"\A[A-Za-z]+\z", "latin"), (r"\A[^\wא-ת]+\z", "punctuation"),
    (r"[A-Za-z].*[א-ת]|[א-ת].*[A-Za-z]", "mixed"), (r"\A[׳״'\"]*[א-ת]+[׳״'\"][א-ת׳״'\"]*\z|\A[׳״'\"]+[א-ת]+\z", "marked"), (r"\A[א-ת]+\z", "word"),
)


def oov_kind(t: Column) -> Column:
    """What a token outside the lexicon is; the first kind that fits."""
    out = F.when(t.isNull(), F.lit(None))
    for pattern, name in OOV_KINDS:
        out = out.when(t.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("other"))


def difference(a: Column, b: Column) -> Column:
    """Struct (a, b) of the first characters in which two words of equal length differ; null if none or of unlike length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.when(F.length(a) == F.length(b), F.get(F.filter(pairs, lambda x: x["a"] != x["b"]), F.lit(0)))


def marked_sentence(words: Column, position: Column) -> Column:
    """The words joined, the one at ``position`` in brackets."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == position, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")


def graphemes(s: Column) -> Column:
    """Array of the user-perceived characters."""
    return F.regexp_extract_all(s, F.lit(r"(\X)"), F.lit(1))


def backspace_width(before: Column) -> Column:
    """Codepoints that one backspace takes: the last user-perceived character; one where nothing is known."""
    return F.coalesce(F.greatest(F.lit(1), F.length(F.try_element_at(graphemes(before), F.lit(-1)))), F.lit(1))


def key_plan(action: Column, output: Column, shifted: Column, before: Column) -> Column:
    """Struct (command, text, count) that a key asks the editor for; an unknown action asks for nothing."""
    plan = lambda command, text=None, count=None: F.struct(F.lit(command).alias("command"), (F.lit(None).cast("string") if text is None else text).alias("text"), (F.lit(None).cast("int") if count is None else count).alias("count"))
    out = F.coalesce(output, F.lit(""))
    typed = F.when(action == "CHARACTER", plan("COMMIT", F.when(shifted, F.upper(out)).otherwise(out))).when(action == "SPACE", plan("COMMIT", F.lit(" ")))
    other = typed.when(action == "BACKSPACE", plan("DELETE", None, backspace_width(before))).when(action == "SWITCH_LAYOUT", plan("SWITCH_LAYOUT", out))
    for name, command in (("ENTER", "EDITOR_ACTION"), ("SHIFT", "TOGGLE_SHIFT"), ("NEXT_INPUT_METHOD", "NEXT_INPUT_METHOD")):
        other = other.when(action == name, plan(command))
    return other


def isolate_runs(s: Column) -> Column:
    """Runs of the other direction wrapped in isolates."""
    return F.regexp_replace(s, "[A-Za-z0-9]+", "⁨$0⁩")


def swap_brackets(s: Column) -> Column:
    return F.translate(s, "()[]{}<>", ")(][}{><")


def should_pin(text: Column, before: Column, pinned: Column) -> Column:
    """Whether the first text of a field needs a direction mark: the field is known to be empty (not null) and unpinned."""
    return ~pinned & F.coalesce(before == "", F.lit(False)) & text.rlike(f"[{HEBREW.letters}]")


def describe(word: Column, kind: Column, replaces: Column) -> Column:
    """Spoken form of a suggestion."""
    says = {"COMPLETION": ", completion", "CORRECTION": ", correction", "NEXT_WORD": ", next word", "ABBREVIATION": ", abbreviation"}
    out = F.when(kind == "REAL_WORD_ERROR", F.concat(word, F.lit(", replaces "), F.coalesce(replaces, F.lit("")), F.lit(" earlier in the sentence")))
    for k, tail in says.items():
        out = out.when(kind == k, F.concat(word, F.lit(tail)))
    return out


def storable(s: Column) -> Column:
    """Why a word can't be kept in a personal dictionary; null if it can. Points don't count as anything but length."""
    word = strip_points(s)
    fits = (F.length(s) <= 32) & (F.length(word) <= 32) & is_word(word)
    why = F.when(s.isNull() | (s == ""), F.lit("empty")).when(F.coalesce(fits, F.lit(False)), F.lit(None))
    return why.when(F.length(s) > 32, F.lit("too long")).when(s.rlike(rf"[{BLANKS}]"), F.lit("more than one word")).when(s.rlike(r"\p{Nd}"), F.lit("digits")).otherwise(F.lit("not letters"))
