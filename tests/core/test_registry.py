"""The registry is whole, and the core doesn't need the subpackage llm."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[2]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180
    assert all(re.fullmatch(r"(q|p\d+)_\w+", name) for name in entry.queries())


def test_core_does_not_import_llm():
    for p in [*ROOT.glob("wordloom/**/*.py"), *ROOT.glob("tests/core/*.py")]:
        if "llm" not in p.relative_to(ROOT / "wordloom" if "wordloom" in p.parts[-3:] else ROOT).parts and p.name != "test_registry.py":
            assert "wordloom.llm" not in p.read_text(), p
