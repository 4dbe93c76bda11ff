"""Every dealt operator and the pipeline are registered, and nothing outside tidegate.llm imports it."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[2]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert set(entry.oracle_sql()) <= set(names)


def test_nothing_else_imports_it():
    for p in (ROOT / "tidegate").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tidegate.llm" not in p.read_text()
