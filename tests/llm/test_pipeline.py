"""The corpus pipeline: every stage against the operator's brute force, and the whole run."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline  # noqa: E402
from test_llm import DOCS, PROSE, SMALL, TEXTS, base_spans, slow_groups, slow_statistics  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "pack":
            assert out.columns == docs.columns
            out = corpus_pipeline.materialise(out, name)
        seen[name] = (docs, out)
        docs = out
    before, after = ([(r["doc_id"], r["text"]) for r in d.collect()] for d in seen["quality_rules"])
    assert 0 < len(after) < len(before) and set(after) <= set(before)
    for _, t in after:
        n, *_, repeated = slow_statistics(t)
        assert n >= 50 and 100 * repeated <= 50 * n
    before, after = ([(r["doc_id"], r["text"]) for r in d.collect()] for d in seen["near_duplicates"])
    groups = slow_groups(before, 5, 80)
    assert sorted(d for d, _ in after) == sorted({g for _, g in groups.values()})
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen["personal_data"])
    assert set(before) == set(after) and not any(base_spans(t) for t in after.values())
    assert all(before[d] == after[d] for d in before if not base_spans(before[d]) and "token" not in before[d])
    before, after = ([(r["doc_id"], r["text"]) for r in d.collect()] for d in seen["mix_sources"])
    assert set(after) <= set(before) and all(after.count(x) <= 3 for x in after)
    assert {r["doc_id"] for r in seen["pack"][1].collect()} == {d for d, _ in after}


def test_awkward_rows(spark, tmp_path):
    rows = [(i, t, "en", None if i % 5 == 0 else "s", None) for i, t in enumerate(TEXTS)] + [(7, PROSE + " " + PROSE.replace("river", "lake"), "en", "s", 1)] * 2 + [(None, PROSE, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() > 0 or name == "quality_rules"
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_clashing_columns(spark):
    """Extra columns named like those that the stages make go through unchanged."""
    names = ["_text", "_base", "_all", "row", "row2", "pattern", "size", "n", "k", "d", "i", "copies", "times", "_h"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, SMALL), name)
        if name != "pack":
            assert out.columns == docs.columns and out.count()
            assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names)
            docs = out


def test_run(spark):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) for _ in range(2))
    assert first and first == again
