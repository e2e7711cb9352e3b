"""K3, D6, X10. A keyword index that is changed in place of being built anew.

Each change adds a segment: the postings and lengths of the documents it brings, and
markers for the keys that it replaces or deletes. A marker ends what older segments hold of its
key. The manifest keeps, for each segment, its documents and their length in all, and what
its markers took from older ones, so that the corpus's size is a sum over the
manifest and no table is read for it. ``merge`` makes one segment of all.

Scores equal those of an index made of the final documents at once. A search reads the
folders of its terms' buckets, in each segment, and drops the postings that a later
marker ended; document frequencies are counted on what is left.

Defined results: a null key is no document; a null text has no terms but counts as a
document; a key that a batch holds twice is an error; deleting an unknown key does nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import retrieval as R
from skein.sources import scratch
from skein.sources import segments as S

MOST_SEGMENTS = 16  #: ``add`` and ``delete`` merge beyond these


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _read(spark: SparkSession, path: str, entries: list[dict], what: str) -> DataFrame | None:
    """One table of the given segments, with the segment's place in the manifest."""
    parts = [spark.read.parquet(f"{S.folder(path, e)}/{what}").withColumn("_at", F.lit(e["at"])) for e in entries if e[what]]
    return _union(parts) if parts else None


def _live(rows: DataFrame, ended: DataFrame | None, key: str) -> DataFrame:
    """Rows that no marker of a later segment ended."""
    if ended is None:
        return rows
    last = ended.groupBy(F.col(key).alias("_k")).agg(F.max("_at").alias("_until"))
    return rows.join(last, (F.col(key) == F.col("_k")) & (F.col("_at") < F.col("_until")), "left_anti")


def _change(spark: SparkSession, path: str, key: str, docs: DataFrame | None, gone: DataFrame) -> int:
    version, entries = S.read(spark, path)
    at = max((e["at"] for e in entries), default=0) + 1
    name, out = S.new_segment(path)
    entry = {"segment": name, "at": at, "postings": False, "docs": False, "ended": False, "n": 0, "length": 0}
    if docs is not None:
        # taken from the texts once: lengths, the sample for the ranges, and the postings read this table
        counted = scratch.written(R.counted_terms(docs.where(F.col(key).isNotNull()).select(key, "text"), key), "terms")
        counted.select(key, "dl").write.parquet(f"{out}/docs")
        own = spark.read.parquet(f"{out}/docs")
        if own.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"a {key} stands twice in one batch")
        R.write_postings(R.postings_of(counted, key), f"{out}/postings", key)
        n, length = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).collect()[0]
        entry |= {"docs": True, "n": n, "length": length, "postings": length > 0}
        gone = own.select(key)
    old = _read(spark, path, entries, "docs")
    if old is not None:
        known = _live(old, _read(spark, path, entries, "ended"), key)
        hit = known.join(gone.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi").select(key, "dl")
        hit.write.parquet(f"{out}/ended")
        n, length = spark.read.parquet(f"{out}/ended").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).collect()[0]
        entry |= {"ended": n > 0, "n": entry["n"] - n, "length": entry["length"] - length}
    version = S.commit(spark, path, version, [*entries, entry])
    return merge(spark, path, key) if len(entries) >= MOST_SEGMENTS else version


def add(docs: DataFrame, path: str, key: str = "doc_id") -> int:
    """Adds documents (key, text) and replaces those whose keys are known; gives the manifest's version."""
    return _change(docs.sparkSession, path, key, docs, docs.select(key))


def delete(keys: DataFrame, path: str, key: str = "doc_id") -> int:
    """Ends the documents of the keys."""
    return _change(keys.sparkSession, path, key, None, keys)


def postings(spark: SparkSession, path: str, key: str = "doc_id", buckets: list[int] | None = None) -> DataFrame | None:
    """bucket, term, key, dl, tf of all documents that count, or of some buckets alone; None without terms."""
    _, entries = S.read(spark, path)
    rows = _read(spark, path, entries, "postings")
    if rows is None:
        return None
    rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    return _live(rows, _read(spark, path, entries, "ended"), key).drop("_at")


def documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame | None:
    """key, dl of all documents that count."""
    _, entries = S.read(spark, path)
    rows = _read(spark, path, entries, "docs")
    return None if rows is None else _live(rows, _read(spark, path, entries, "ended"), key).drop("_at")


def size(spark: SparkSession, path: str) -> DataFrame:
    """n_docs and avg_dl, from the manifest alone."""
    _, entries = S.read(spark, path)
    n, length = sum(e["n"] for e in entries), sum(e["length"] for e in entries)
    return spark.createDataFrame([(n, length / n if n else None)], "n_docs long, avg_dl double")


def merge(spark: SparkSession, path: str, key: str = "doc_id") -> int:
    """Makes one segment of all; readers of older versions keep theirs until ``segments.forget``."""
    version, entries = S.read(spark, path)
    name, out = S.new_segment(path)
    docs, rows = documents(spark, path, key), postings(spark, path, key)
    entry = {"segment": name, "at": max((e["at"] for e in entries), default=0) + 1, "postings": rows is not None, "docs": docs is not None, "ended": False, "n": sum(e["n"] for e in entries), "length": sum(e["length"] for e in entries)}
    if docs is not None:
        docs.write.parquet(f"{out}/docs")
    if rows is not None:
        R.write_postings(rows, f"{out}/postings", key)
    return S.commit(spark, path, version, [entry])


def asked_buckets(queries: DataFrame) -> list[int]:
    """The buckets of the queries' terms: ``retrieval.BUCKETS`` numbers at most."""
    terms = queries.select(F.explode(X.terms(F.col("text"))).alias("term"))
    return sorted(r[0] for r in terms.select(R.bucket_of(F.col("term"))).distinct().collect())


def search(spark: SparkSession, path: str, queries: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """query_id, key, score of the documents that hold a term of a query (query_id, text)."""
    rows = postings(spark, path, key, asked_buckets(queries))
    if rows is None:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} long, score double")
    return R.bm25_of(rows, size(spark, path), queries, key, **options)
