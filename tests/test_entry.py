import importlib

import pytest

entry_module = importlib.import_module("__spark_entry__")


def test_entry(spark, data):
    assert entry_module.entry(spark).count() > 0


def test_registry():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert sql.keys() <= queries.keys()


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(entry_module.__file__).parent / "civicspark"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "civicspark.llm" not in path.read_text()


