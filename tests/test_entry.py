import importlib

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    import pathlib
    import re

    root = pathlib.Path(importlib.import_module("mergekin").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) mergekin\.llm", p.read_text(), re.M), p
