"""The queries that SQL can express, against DuckDB over whole tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import duck, duck_rows, spark_rows  # noqa: E402

from skein.llm.oracles import ORACLES  # noqa: E402
from skein.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duck_rows(duck(FOLDER), ORACLES[name])
