"""Sections packed by expressions, against the plain fold; nothing of it goes through Python."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from skein.operators import chunking
from skein.plans import catalog

DOCS = "doc_id long, text string"


@pytest.mark.parametrize(("target", "overlap"), [(400, 60), (100, 20), (10, 0), (50, 49), (50, 80)])
def test_sections_as_the_plain_fold_packs_them(spark, target, overlap):
    rng = random.Random(target)
    docs = [(i, "\n\n".join("x" * rng.choice([0, 1, 3, 4, 40, rng.randrange(1, 300), rng.randrange(1, 900)]) for _ in range(rng.randrange(400 if i % 9 == 0 else 40)))) for i in range(300)]
    docs += [(-1, None), (-2, ""), (-3, " \n \n "), (-4, "é\U0001f600" * 5 + "\n\n" + "b" * 9)]
    got: dict = {}
    for r in chunking.section_chunks(spark.createDataFrame(docs, DOCS), target=target, overlap=overlap).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_num"], r["first"], r["last"], r["tokens"], r["total_chunks"], r["text"]))
    for key, text in docs:
        parts = [p for p in (text or "").split("\n\n") if p.strip()]
        found = chunking.pack_sections(parts, target, overlap)
        assert sorted(got.get(key, [])) == [(i, a, b, n, len(found), "\n\n".join(parts[a : b + 1])) for i, a, b, n in found]


def test_section_chunks_need_no_python(spark):
    """F16: Python workers held batches of whole texts."""
    plan = catalog.QUERIES["t12_section_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan


def test_pairs_meet_python_at_the_model_alone(spark):
    """a task had two Python workers at once, of which one packed sections."""
    plan = catalog.QUERIES["c6_make_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_large_documents(spark):
    """Many sections, and many chunks, in one document."""
    docs = spark.createDataFrame([(0, "a\n\n" * 333_000), (1, ("word " * 20 + "\n\n") * 20_000), (2, "abcd\n\n" * 100_000)], DOCS).repartition(3)
    began = time.perf_counter()
    found = chunking.section_chunks(docs, target=10, overlap=1).groupBy("doc_id").agg(F.count(F.lit(1)), F.sum("tokens")).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 0), (1, 20_000, 20_000 * 24), (2, 11_111, 11_111 * 10)]
    assert time.perf_counter() - began < 60
