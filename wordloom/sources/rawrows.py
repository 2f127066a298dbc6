"""Separated records that may be broken: every record is either loaded with typed fields or set apart with a reason.

A schema is a list of fields. From it one anchored pattern for the whole record is generated; a record that the
pattern accepts is loaded by the same pattern's groups. The records it refuses pass through the incremental
prefix patterns of the schema, of which the first that fails names the broken field. Everything is a Java regular
expression, so no row leaves the JVM. All repetitions are possessive: they neither backtrack nor recurse, whatever
the length of a record.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hebrew points and accents, dropped before letters are tested (fixed values).
POINTS = r"֑-ׇ"
#: Letters and the presentation forms whose canonical decomposition is one letter and points (fixed values).
LETTERS = r"א-תיִשׁ-זּטּ-לּמּנּסּףּפּצּ-פֿ"


def int_pattern(most: int) -> str:
    """A pattern of decimal digits, with any leading zeros, whose value is at most ``most``."""
    digits = str(most)
    parts = [rf"[0-9]{{1,{len(digits) - 1}}}"] if len(digits) > 1 else []
    for i, d in enumerate(digits):
        rest = len(digits) - i - 1
        if d != "0":
            low = "0" if i else "1"
            if int(d) - 1 >= int(low):
                parts.append(rf"{digits[:i]}[{low}-{int(d) - 1}]" + (rf"[0-9]{{{rest}}}" if rest else ""))
    parts.append(digits)
    return rf"0*(?:{'|'.join(parts)})"


def date_pattern() -> str:
    """A pattern of the real dates yyyy-mm-dd of the years 0001 to 9999."""
    year = r"(?!0000)[0-9]{4}"
    leap = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
    long_, short = r"(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])", r"(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)"
    return rf"(?:{year}-(?:{long_}|{short}|02-(?:0[1-9]|1[0-9]|2[0-8]))|(?!0000){leap}-02-29)"


@dataclass(frozen=True)
class Field:
    """A field: its name, the pattern its unquoted value must match (None: any value) and the type it loads as."""

    name: str
    pattern: str | None = None
    cast: str = "string"


#: The six fields of a verb paradigm record.
VERB_FIELDS = (
    Field("vocalized_inflection", rf"[{POINTS}]*+[{LETTERS}][{LETTERS}{POINTS}]*+"),
    Field("base_form"),
    Field("morphology"),
    Field("attested", int_pattern(2**31 - 1), "int"),
    Field("checked_on", date_pattern(), "date"),
    Field("note"),
)

#: A field as it stands in a record: in quotes, where a doubled quote stands for one, or without.
_QUOTED = r'"(?:[^"]|"")*+"(?=,|\z)'
_ANY = rf'(?:{_QUOTED}|(?!")[^,]*+)'


def _raw(field: Field) -> str:
    return _ANY if field.pattern is None else rf'(?:"{field.pattern}"(?=,|\z)|{field.pattern}(?=,|\z))'


def quoting_pattern() -> str:
    """Matches a record of any number of fields whose quotes are in order."""
    return rf"\A{_ANY}(?:,{_ANY})*+\z"


def width_pattern(n: int) -> str:
    """Matches a record of exactly ``n`` fields whose quotes are in order."""
    return rf"\A{_ANY}(?:,{_ANY}){{{n - 1}}}\z"


def row_pattern(fields: tuple[Field, ...]) -> str:
    """The anchored pattern of a whole valid record, with a group for each field."""
    return r"\A" + ",".join(f"({_raw(f)})" for f in fields) + r"\z"


def prefix_patterns(fields: tuple[Field, ...]) -> list[str]:
    """Patterns of the first 1, 2, ... fields; the first that fails names the broken field."""
    return [r"\A" + ",".join(_raw(f) for f in fields[: i + 1]) + r"(?=,|\z)" for i in range(len(fields))]


def classify(raw: Column, fields: tuple[Field, ...]) -> tuple[Column, Column]:
    """(reason, position from 1 of the first broken field) of a record; both null for a valid one.

    A null record can't be read as fields at all: it is broken for ``columns``.
    """
    body = F.regexp_replace(raw, r"\r\z", "")
    quotes, width = body.rlike(quoting_pattern()), body.rlike(width_pattern(len(fields)))
    valid = body.rlike(row_pattern(fields))
    reason = F.when(raw.isNull(), F.lit("columns")).when(valid, F.lit(None)).when(~quotes, F.lit("quoting")).when(~width, F.lit("columns")).otherwise(F.lit("value"))
    first = F.when(raw.isNull(), F.lit(1)).when(valid, F.lit(None).cast("int"))
    for i, p in enumerate(prefix_patterns(fields)):
        first = first.when(~body.rlike(p), F.lit(i + 1))
    return reason, first.otherwise(F.lit(len(fields) + 1))


def parse_records(df: DataFrame, fields: tuple[Field, ...] = VERB_FIELDS, raw: str = "raw", key: tuple[str, ...] = ("src_file", "line_no"), header_line: int | None = 1) -> DataFrame:
    """One row per record: the key, ``reason`` and ``broken_field`` (null if valid) and the typed fields (null if broken).

    Records repeated under one key count once; of unlike records under one key the first by text stands. Records
    whose line number is ``header_line`` are no data and are left out; a null line number is data. A null or
    empty record is broken. Columns of ``df`` other than the key and ``raw`` are ignored, whatever their names.
    """
    rows = df.select(*key, F.col(raw).alias("_raw"))
    if header_line is not None:
        rows = rows.filter(F.coalesce(F.col(key[-1]) != header_line, F.lit(True)))
    rows = rows.groupBy(*key).agg(F.min("_raw").alias("_raw"))
    reason, first = classify(F.col("_raw"), fields)
    rows = rows.withColumn("reason", reason).withColumn("broken_field", F.when(F.col("reason").isNotNull(), first))
    body, pattern = F.regexp_replace("_raw", r"\r\z", ""), row_pattern(fields)
    out = [*key, "reason", "broken_field"]
    for i, f in enumerate(fields):
        text = F.regexp_extract(body, pattern, i + 1)
        text = F.when(text.startswith('"'), F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))).otherwise(text)
        out.append(F.when(F.col("reason").isNull(), text.cast(f.cast) if f.cast != "date" else F.to_date(text, "yyyy-MM-dd")).alias(f.name))
    return rows.select(*out)


def broken(df: DataFrame, **kwargs) -> DataFrame:
    """The records set apart: key, reason and broken field."""
    key = kwargs.get("key", ("src_file", "line_no"))
    return parse_records(df, **kwargs).filter(F.col("reason").isNotNull()).select(*key, "reason", "broken_field")


def loaded(df: DataFrame, fields: tuple[Field, ...] = VERB_FIELDS, **kwargs) -> DataFrame:
    """The valid records with their typed fields."""
    key = kwargs.get("key", ("src_file", "line_no"))
    return parse_records(df, fields, **kwargs).filter(F.col("reason").isNull()).select(*key, *(f.name for f in fields))


def against_manifest(parsed: DataFrame, stats: DataFrame) -> DataFrame:
    """Per file: records read and rejected, by reason, beside the manifest's figures; ``agrees`` is null where it states none.

    A file without a manifest row, and a manifest row without records, both stay.
    """
    by = parsed.groupBy("src_file").agg(
        F.count("*").alias("n_read"), F.count_if(F.col("reason").isNotNull()).alias("n_rejected"),
        *(F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"n_{r}") for r in ("quoting", "columns", "value")),
    )
    said = stats.groupBy("src_file").agg(F.max("rows_read").alias("stated_read"), F.max("rows_rejected").alias("stated_rejected"))
    out = by.join(said, "src_file", "full_outer")
    return out.withColumn("agrees", (F.col("n_read") == F.col("stated_read")) & (F.col("n_rejected") == F.col("stated_rejected")))


def valid_python(fields: tuple[Field, ...], record: str) -> re.Match | None:
    """The same whole-record pattern on one Python string, for tests and for single records."""
    return re.match(row_pattern(fields).replace(r"\z", r"\Z"), record[:-1] if record.endswith("\r") else record)
