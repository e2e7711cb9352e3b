"""Every query of the core library against its SQL, over whole tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))
from compare import duck, duck_rows, spark_rows  # noqa: E402

from skein.plans.catalog import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    names, rows = spark_rows(QUERIES[name](spark, FOLDER))
    assert len(set(names)) == len(names)
    if name in ORACLES:
        assert (names, rows) == duck_rows(sql, ORACLES[name])
    else:
        assert rows


def test_entry_imports_without_the_optional_parts(spark, monkeypatch):
    import importlib

    for name in ("skein.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
    monkeypatch.undo()
    importlib.reload(entry)
