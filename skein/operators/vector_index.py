"""K1, D5. An approximate vector index: centroid leaves as folders, of which a search reads some.

Centroids are fitted on a bounded sample, in tasks: the driver holds them alone; every vector goes to the leaf of its nearest
centroid, and a leaf is a folder of as many files as its size asks for. A search ranks
the centroids for each query, reads the folders of its nearest ones alone, and scores
what they hold exactly, in blocks, as ``retrieval.nearest`` does with all vectors.

How many leaves a query has to read is measured when the index is written: the true
neighbours of a sample of vectors are found by the exact way, and the index keeps the
number of leaves that holds ``recall`` of them. Reading all leaves is exact.

Defined results: vectors that are null, empty, zero or not finite aren't in the index and
find nothing as queries; vectors of another length than the sample's first are in a leaf of
their own (-1), which every query of another length than the centroids reads.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import arrays as A
from skein.operators import retrieval as R
from skein.sources import scratch

LEAF = 4096  #: vectors of a leaf on average
MOST_LEAVES = 4096  #: folders; beyond, leaves grow, and their files with them
SAMPLE = 32  #: vectors of the sample for each leaf
ASKED = 128  #: vectors whose true neighbours are measured
NEIGHBOURS = 10
RECALL = 0.95
FILE = 1 << 18  #: vectors of a file
ROUNDS = 8
SEED = 7
HASHES = 1 << 31  #: values of the hash that draws the sample


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """h, raw: about ``most`` of ``n`` usable vectors (key, v) by a hash of their keys, written as unit rows; nothing is ordered or brought together."""
    key, schema = rows.columns[0], "h long, raw binary"

    def run(batches):
        for batch in batches:
            _, flat, begin, usable = A.spread(batch.column(1))
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size[usable]):
                at = np.flatnonzero(usable & (size == d))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), A.rows_of(_unit(flat[begin[at][:, None] + np.arange(d)]))], names=["h", "raw"])

    hashed = rows.select(F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(HASHES)).alias("h"), "v")
    return scratch.written(hashed.where(F.col("h") < math.ceil(HASHES * min(1.0, most / max(n, 1)))).mapInArrow(run, schema), "sample")


def centroids_of(sample: DataFrame, n: int, leaves: int) -> np.ndarray:
    """Spherical k-means on a sample (h, raw) of about ``n`` unit rows, those of the first one's length; a centroid that loses all keeps its place.

    A round assigns and sums the sample where it lies, and only the sums, a row for each
    leaf, come to the driver. They are sums of whole numbers, so that their order doesn't matter.
    """
    bound = sample.agg(F.max("h")).collect()[0][0]
    if bound is None:
        return np.zeros((1, 1))
    few = sample.where(F.col("h") <= bound * min(1.0, (2 * leaves + 64) / max(n, 1)))
    first = [bytes(r[0]) for r in few.orderBy("h", "raw").limit(leaves).select("raw").collect()]
    first = first or [bytes(sample.orderBy("h", "raw").limit(1).select("raw").collect()[0][0])]
    c = np.array([np.frombuffer(x) for x in first if len(x) == len(first[0])])
    for _ in range(ROUNDS):
        for leaf, sums in _leaf_sums(sample, c).collect():
            total = np.frombuffer(bytes(sums), np.int64).astype(float)
            if total.any():
                c[leaf] = total / np.linalg.norm(total)
    return c


def _leaf_sums(sample: DataFrame, c: np.ndarray) -> DataFrame:
    """leaf, sums: those of the sample's rows that are nearest to a centroid, as whole numbers of 2**-40."""

    def added(leaf: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(leaf, kind="stable")
        some, begin = np.unique(leaf[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(some), A.rows_of(np.add.reduceat(x[order], begin))], names=["leaf", "sums"])

    def assign(batches):
        for batch in A.pieces(batches):
            raw = batch.column(0).filter(pa.array(A.lengths(batch.column(0)) == c.shape[1] * 8))
            x = A.matrix(raw, "<f8")
            if len(x):
                at = np.concatenate([_nearest(x[a : a + _step(c)], c) for a in range(0, len(x), _step(c))])
                yield added(at, np.rint(x * 2.0**40).astype(np.int64))

    def total(batches):
        held = None
        for batch in (b for b in batches if b.num_rows):
            now = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = added(now.column(0).to_numpy(), A.matrix(now.column(1), "<i8"))
        if held is not None:
            yield held

    schema = "leaf long, sums binary"
    return sample.select("raw").mapInArrow(assign, schema).repartition("leaf").mapInArrow(total, schema)


def _step(c: np.ndarray) -> int:
    """Rows that meet the centroids at once: some 8 MB of products."""
    return max(1, (1 << 20) // len(c))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T).argmax(axis=1).astype(np.int64)


def _with_leaves(rows: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """``rows`` (key, v) with the ``most`` nearest leaves of each, a row for each leaf; -1 for vectors of another length."""
    schema = rows.schema
    key = schema[0].name

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, begin = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            same = np.flatnonzero(size == centroids.shape[1])
            row, leaf = [np.flatnonzero(size != centroids.shape[1])], [np.full(int((size != centroids.shape[1]).sum()), -1)]
            for a in range(0, len(same), _step(centroids)):
                part = same[a : a + _step(centroids)]
                scores = _unit(flat[begin[part][:, None] + np.arange(centroids.shape[1])]) @ centroids.T
                near = np.argsort(-scores, axis=1, kind="stable")[:, :most] if most > 1 else scores.argmax(axis=1)[:, None]
                row.append(np.repeat(part, near.shape[1]))
                leaf.append(near.reshape(-1))
            row, leaf = np.concatenate(row), np.concatenate(leaf)
            for a in range(0, len(row), 8192):
                got = batch.take(pa.array(row[a : a + 8192]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[a : a + 8192].astype(np.int64)), *got.columns], names=["leaf", key, "v"])

    kind = schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"leaf long, {key} {kind}, v array<double>")


def write(vectors: DataFrame, path: str, key: str = "vec_id", leaf: int = LEAF, recall: float = RECALL) -> dict:
    """Writes the index of ``vectors`` (key, embedding) below a path; gives its description."""
    spark = vectors.sparkSession
    rows = R.vector_rows(vectors, key).where(R.whole(F.col("v")))
    n = rows.count()
    leaves = max(1, min(MOST_LEAVES, n // leaf))
    most = max(SAMPLE * leaves, ASKED)
    centroids = centroids_of(_sampled(rows, n, most), min(n, most), leaves)
    placed = _with_leaves(rows, centroids, 1)
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(FILE)).alias("files"))  # a row a leaf
    dealt = placed.join(F.broadcast(sizes), "leaf").withColumn("_f", F.pmod(F.xxhash64(key), F.col("files"))).repartition("leaf", "_f")
    dealt.select("leaf", key, F.col("v").alias("embedding")).write.partitionBy("leaf").parquet(f"{path}/leaves")
    about = {"key": key, "n": n, "dim": int(centroids.shape[1]), "leaves": len(centroids), "probes": len(centroids), "recall": recall}
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "leaf long, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    if n > 1:
        about["probes"] = _measured(rows, centroids, key, recall)
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")
    return about


def _measured(rows: DataFrame, centroids: np.ndarray, key: str, recall: float) -> int:
    """Leaves that ``recall`` of the true neighbours of a sample of vectors lie in."""
    vectors = rows.withColumnRenamed("v", "embedding")
    asked = vectors.orderBy(F.xxhash64(F.col(key), F.lit(SEED)), key).limit(ASKED).select(F.col(key).alias("query_id"), "embedding")
    near = R.nearest(vectors, asked, NEIGHBOURS + 1, key).where(F.col("query_id") != F.col(key))
    pairs = near.join(vectors.select(key, F.col("embedding").alias("b")), key).join(asked.select("query_id", F.col("embedding").alias("a")), "query_id").select("a", "b").collect()
    dim = centroids.shape[1]
    pairs = [(r["a"], r["b"]) for r in pairs if len(r["a"]) == len(r["b"]) == dim]
    if not pairs:
        return len(centroids)
    order = np.argsort(-(_unit(np.array([a for a, _ in pairs], float)) @ centroids.T), axis=1, kind="stable")
    leaf = (_unit(np.array([b for _, b in pairs], float)) @ centroids.T).argmax(axis=1)
    place = np.sort((order == leaf[:, None]).argmax(axis=1))
    return int(place[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1


def described(spark: SparkSession, path: str) -> dict:
    """What ``write`` says of an index."""
    return json.loads(spark.read.text(f"{path}/about").collect()[0][0])


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["v"] for r in spark.read.parquet(f"{path}/centroids").orderBy("leaf").collect()])


def candidates(spark: SparkSession, path: str, queries: DataFrame, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries by leaf, the leaves' vectors): of the index, the folders that a query asks for and no others."""
    about = described(spark, path)
    asked = R.vector_rows(queries, "query_id").where(R.whole(F.col("v")))
    asked = _with_leaves(asked, _centroids(spark, path), min(about["leaves"], probes or about["probes"]))
    wanted = sorted(r[0] for r in asked.select("leaf").distinct().collect())  # at most MOST_LEAVES and one
    return asked, spark.read.parquet(f"{path}/leaves").where(F.col("leaf").isin(wanted))


def search(spark: SparkSession, path: str, queries: DataFrame, n: int, probes: int | None = None) -> DataFrame:
    """query_id, key, score, rank: the n best vectors found of each query (query_id, embedding) by cosine, ties by key.

    ``probes`` are the leaves that a query reads: by default those that the index was
    measured to need; with as many as it has the result is exact, and all leaves are read as one
    table. A query isn't dealt to its leaves, which would take the product of both: blocks of queries
    meet the leaves, and of a block those queries are compared that have the leaf among their nearest.
    """
    about = described(spark, path)
    key = about["key"]
    if probes is not None and probes >= about["leaves"]:
        return R.nearest(spark.read.parquet(f"{path}/leaves").select(key, "embedding"), queries, n, key)
    rows = candidates(spark, path, queries, probes)[1].select(F.col("leaf").cast("long").alias("leaf"), key, F.col("embedding").alias("v"))
    centroids, most = _centroids(spark, path), min(about["leaves"], probes or about["probes"])

    def cut(x: np.ndarray) -> np.ndarray:
        """The score that a leaf's centroid has to reach for each query; sums in another order may differ in their last digits."""
        step = _step(centroids)
        return np.concatenate([np.partition(x[a : a + step] @ centroids.T, -most, axis=1)[:, -most] for a in range(0, len(x), step)]) - 1e-12

    def run(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by block of queries
        for batch in batches:
            at, qs, qraw, leaf, vs, vraw = batch.columns
            for i in range(batch.num_rows):
                q, v, a, b, own = qs[i].values, vs[i].values, qraw[i].as_buffer(), vraw[i].as_buffer(), leaf[i].as_py()
                if a.size * len(v) == b.size * len(q):
                    x, y = np.frombuffer(a).reshape(len(q), -1), np.frombuffer(b).reshape(len(v), -1)
                    if at[i].as_py() not in seen:
                        seen[at[i].as_py()] = np.full((len(q), n), -np.inf), cut(x) if own >= 0 else np.empty(0)
                    top, least = seen[at[i].as_py()]
                    near = np.flatnonzero(x @ centroids[own] >= least) if own >= 0 else np.arange(len(q))
                    tops = top[near]
                    r, c, score = R.risen(x[near], y, tops)
                    top[near] = tops
                    if len(r):
                        yield pa.RecordBatch.from_arrays([q.take(pa.array(near[r])), v.take(pa.array(c)), pa.array(score)], names=["query_id", key, "score"])

    pairs = R.paired(R.vector_rows(queries, "query_id"), rows, by="leaf").select("qat", "qs", "qraw", "leaf", "vs", "raw")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score double"
    return R.best(pairs.mapInArrow(run, schema), n, key)
