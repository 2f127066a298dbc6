"""Broken records against a hand-written record reader."""

import datetime
import random
import unicodedata

from wordloom.sources import rawrows

HEADER = "vocalized_inflection,base_form,morphology,attested,checked_on,note"


def by_hand(raw):
    """Reason of a record, read character by character."""
    if raw is None:
        return "columns"
    s = raw[:-1] if raw.endswith("\r") else raw
    fields, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            j, value = i + 1, ""
            while True:
                if j >= len(s):
                    return "quoting"
                if s[j] == '"':
                    if s[j + 1 : j + 2] == '"':
                        value, j = value + '"', j + 2
                        continue
                    break
                value, j = value + s[j], j + 1
            j += 1
            if j < len(s) and s[j] != ",":
                return "quoting"
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            value = s[i:j]
        fields.append(value)
        if j >= len(s):
            break
        i = j + 1
    if len(fields) != 6:
        return "columns"
    word = "".join(c for c in unicodedata.normalize("NFC", fields[0]) if not 0x591 <= ord(c) <= 0x5C7)
    ok = word != "" and all("א" <= c <= "ת" for c in word)
    ok = ok and fields[3] != "" and all(c in "0123456789" for c in fields[3]) and int(fields[3]) < 2**31
    try:
        d = datetime.date(int(fields[4][:4]), int(fields[4][5:7]), int(fields[4][8:]))
        ok = ok and d.isoformat() == fields[4]
    except ValueError:
        ok = False
    return None if ok else "value"


def records():
    rnd = random.Random(7)
    first = ["כָלַו", '"כָלַו"', "שׁוּב", "", "abc", "ﬡב", '"א', "א ב", "ְ", "אֳ" * 3]
    numbers = ["0", "2147483647", "2147483648", "0002147483647", "99999999999", "-1", "1.0", "", '"12"', "٣", "1147483648", "2140000000"]
    dates = ["2024-02-29", "2023-02-29", "2000-02-29", "1900-02-29", "2024-04-31", "2024-13-01", "2024-1-1", "0000-01-01", '"2024-05-05"', "2024-05-05 "]
    notes = ["", '""', '"a,b"', 'he said "x"', '"a""b"', '"open', '"a"b', '"two\nlines"', '"x"\r', "end\r", '"""', '""""', "a,b", "\r\r"]
    out = [None, "", "\r", ",,,,,", '"', '""', "a,b,c", HEADER]
    for _ in range(1500):
        good = lambda xs, k: xs[rnd.randrange(k)] if rnd.random() < 0.7 else rnd.choice(xs)
        out.append(",".join([good(first, 3), rnd.choice(["", "כָלַו", '"x,y"']), "PAL", good(numbers, 2), good(dates, 1), rnd.choice(notes)]))
    return out


def test_reasons_and_values(spark):
    rows = [("f", i + 2, r, "clash") for i, r in enumerate(records())]
    rows += [("f", 1, HEADER, "x"), ("f", None, "x", "x"), *rows[:5]]
    df = spark.createDataFrame(rows, "src_file string, line_no bigint, raw string, reason string")
    got = {(r.src_file, r.line_no): r for r in rawrows.parse_records(df).collect()}
    assert len(got) == len(records()) + 1 and ("f", 1) not in got
    for _, line, raw, _ in rows[: len(records())]:
        assert got["f", line].reason == by_hand(raw), (raw, got["f", line])
    valid = [r for r in got.values() if r.reason is None]
    assert len(valid) > 100 and all(r.attested is not None and r.checked_on is not None and r.broken_field is None for r in valid)
    assert any(r.note == 'a"b' for r in valid) and any(r.note == "a,b" for r in valid) and any(r.note == "two\nlines" for r in valid)
    assert got["f", None].reason == "columns"


def test_first_broken_field(spark):
    rows = [("f", 2, "x,,,1,2024-01-01,"), ("f", 3, "א,,,y,2024-01-01,"), ("f", 4, "א,,,1,2024-01-32,"), ("f", 5, "א,,,1,2024-01-01"), ("f", 6, 'א,"b')]
    df = spark.createDataFrame(rows, "src_file string, line_no bigint, raw string")
    assert {r.line_no: r.broken_field for r in rawrows.broken(df).collect()} == {2: 1, 3: 4, 4: 5, 5: 6, 6: 2}


def test_very_long_record_and_empty_table(spark):
    long = "א" * 200_000 + ',,,1,2024-01-01,"' + '""' * 300_000 + '"'
    df = spark.createDataFrame([("f", 2, long), ("f", 3, long[:-1])], "src_file string, line_no bigint, raw string")
    got = {r.line_no: r for r in rawrows.parse_records(df).collect()}
    assert got[2].reason is None and got[2].note == '"' * 300_000 and got[3].reason == "quoting"
    assert rawrows.parse_records(df.limit(0)).count() == 0


def test_manifest_keeps_both_sides(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("b", 2, "א,,,1,2024-01-01,")], "src_file string, line_no bigint, raw string")
    stats = spark.createDataFrame([("a", 1, 1), ("c", 5, None)], "src_file string, rows_read bigint, rows_rejected bigint")
    got = {r.src_file: r for r in rawrows.against_manifest(rawrows.parse_records(df), stats).collect()}
    assert got["a"].agrees and got["b"].agrees is None and got["c"].n_read is None and set(got) == {"a", "b", "c"}


def test_first_broken_field_in_a_query(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [("f", 2, "כתב,כתב,x,1,2024-01-01,"), ("f", 3, "כתב,כתב,x,-1,2024-01-01,"), ("f", 4, "כתב,כתב,x,1,2024-13-01,"), ("f", 5, 'כתב,"כתב,x,1,2024-01-01,'), ("f", 6, None)]
    spark.createDataFrame(rows, "src_file string, line_no bigint, raw string").write.parquet(f"{tmp_path}/verb_raw.parquet")
    got = {r.line_no: (r.reason, r.broken_field) for r in entry.queries()["p2_broken_fields"](spark, str(tmp_path)).collect()}
    assert got == {3: ("value", 4), 4: ("value", 5), 5: ("quoting", 2), 6: ("columns", 1)}
