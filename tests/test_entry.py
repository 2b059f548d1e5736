"""The entry point, with and without the corpus operators."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_not_import_the_corpus_operators():
    for path in (ROOT / "fieldquarry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_one_query_for_each_operator():
    if (ROOT / "fieldquarry/llm").exists() and entry._llm:
        numbers = sorted(int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q)))
        assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_flagship(spark):
    got = entry.entry(spark)
    assert len(got.columns) == 9 and got.count() > 0
