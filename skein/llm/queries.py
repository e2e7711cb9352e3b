"""The registered queries of the training-data operators; their SQL is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import arrays
from skein.llm import cross_polytope, hard_negatives, heap_lloyd, html, mixing, packing, pii, quality, quotes, sharding, shingle_join, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_manifest(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.groups(table(spark, sf_dir, "documents"))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is an anchor; every seventh has the next label."""
    e = F.col("embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # null where a component is null or not finite
    x = F.when(arrays.finite(e), F.transform(e, lambda c: F.floor(c.cast("double") * 256)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), (F.col("vec_id") % 100 == 0).alias("anchor"), x.alias("x"))
    return hard_negatives.mine(rows)


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is a query."""
    vectors = table(spark, sf_dir, "embeddings")
    return cross_polytope.search(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_sharding, op3_quality, op4_vectors, op5_warc, op6_packing, op7_mixing, op8_html, op9_shingle_join, op10_quotes, op11_codes, op12_hard_negatives, op13_cross_polytope)}
