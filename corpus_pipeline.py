"""The corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage is one operator, gets what its predecessor kept as a table, and returns
documents, but for the last, which returns the packed pieces. Reruns give equal rows.

Defined results, by stage: a null text has no words and goes at the first; documents
without words, or without an id, are duplicates of nothing; a null text stays null where
personal data is replaced; a null source is a source of its own; a null text that
reaches the last stage has its end token only. Further columns, whatever their names,
go along up to the last stage; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, packing, pii, quality, shingle_join
from skein.llm.common import materialise

#: Near duplicates: words in an n-gram, similarity in per cent.
WORDS, PERCENT = 5, 80
ORDER = "pack-1"  #: seed of the order in which documents are packed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the trees are fitted on the labels of this corpus."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_quality(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest id, once.

    Documents without words are a group each; those without an id stay.
    """
    found = shingle_join.groups(docs, WORDS, PERCENT)
    keep = materialise(found.where("doc_id is null or doc_id = component_id").select("doc_id").distinct(), "kept").alias("k")
    rows = docs.alias("d")
    # as many rows as documents stay: never a broadcast
    rows = rows.join(keep.hint("merge"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")), "left_semi")
    # an id that is repeated stands once, with the text of the least hash; a null id names no document
    often = materialise(docs.groupBy(docs["doc_id"].cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null"), "repeated").alias("o")
    same = F.col("d.doc_id").cast("long") == F.col("o.doc_id")
    cells = F.struct(*(F.col(f"d.`{c}`") for c in docs.columns))
    first = F.min_by(cells, F.struct(F.sha2(F.col("d.text"), 256), F.to_json(cells)))
    one = rows.join(often, same, "left_semi").groupBy(F.col("d.doc_id").cast("long").alias("i")).agg(first.alias("d"))
    return rows.join(often, same, "left_anti").unionByName(one.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind, and their lengths as they are then."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    The documents are packed in a seeded random order, the same on every run: sequences
    mix sources, and neither files nor partitions decide what lies next to what.
    """
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64(F.lit(ORDER), "doc_id", "text"))
    order = ("_h", "doc_id", "text")
    return packing.pack(rows.repartitionByRange("_h", "doc_id").sortWithinPartitions(*order))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL expresses neither the trees nor the tokenizer; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = materialise(out, name) if i < len(STAGES) - 1 else out
    return docs
