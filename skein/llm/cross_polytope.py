"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a fast pseudo-rotation (random signs and a Hadamard transform, three
times) and assigned to the nearest of the signed axes; where buckets should be finer,
several such axes, the last among fewer dimensions, make one bucket. A query looks into
the buckets of its nearest axes in order (multiprobe), in several tables, and what they
hold is ranked by exact distances in double precision.

How fine the buckets are, how many tables there are and how many buckets a query looks
into comes from a measurement: the true neighbours of up to ``SAMPLE`` queries are found
in one pass over all vectors, and the cheapest setting is taken that meets ``recall`` of
them, and ``recall`` less ``SLACK`` of them in each quarter of the queries by distance.
Looking into all buckets of a table is exact, so that some setting always does.

Equal vectors are one, with their k + 1 smallest ids, as no list can hold more of them;
equal queries are asked once. A bucket with more than ``BLOCK`` vectors or queries, however
hot, is dealt in pairs of blocks of both. Each task gives k + 1 rows for a query and
block at most, so that what is shuffled back doesn't grow with the buckets.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do null ids; vectors of different lengths are never near; an id counts
once, at its nearest vector, however often it is repeated; an empty table gives an empty
result; fewer than k candidates give all. Nearness is the Euclidean distance of the vectors
as they are, ties go to the smaller id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.arrays import by_length, finite, kind_of, matrix, raws
from skein.llm.common import materialise

RECALL = 0.95
SLACK = 0.03  #: what a quarter of the queries may lack of the recall
SAMPLE = 96  #: queries whose true neighbours are measured
TABLES = 12  #: most tables
PROBES = 512  #: most buckets of several axes that a query looks into in a table
BLOCK = 4096  #: vectors, and queries, of a bucket that one task compares at once
ROW, PAIR = 2e-6, 5e-8  #: seconds that moving a row, and comparing a pair, take about
CELLS = 1 << 22  #: buckets that are ordered at once
SEED = 13


class Setting(NamedTuple):
    """Dimensions of the cross-polytopes that make a bucket, tables, and buckets that a query looks into in each."""

    polytopes: tuple[int, ...]
    tables: int
    probes: int

    @property
    def buckets(self) -> int:
        return int(np.prod([2 * p for p in self.polytopes]))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Unit rows under the pseudo-rotation of a table's ``part``-th polytope, the same on every machine."""
    d = 1 << (x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([SEED, x.shape[1], table, part]).choice([-1.0, 1.0], (3, d))
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return y


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signed(y: np.ndarray) -> np.ndarray:
    """Products with all signed axes: +1, -1, +2, -2 and so on."""
    return np.stack((y, -y), axis=2).reshape(len(y), -1)


def bucket(x: np.ndarray, table: int, polytopes: tuple[int, ...]) -> np.ndarray:
    """The bucket of each unit row in a table."""
    code = np.zeros(len(x), np.int64)
    for part, d in enumerate(polytopes):
        code = code * (2 * d) + signed(rotated(x, table, part)[:, :d]).argmax(axis=1)
    return code


def probes(x: np.ndarray, table: int, polytopes: tuple[int, ...], most: int) -> np.ndarray:
    """The buckets of each unit row in a table, most promising first: ``most`` of them, or all."""
    step = max(1, CELLS // (most * 2 * max(polytopes)))
    if len(x) > step:
        return np.concatenate([probes(x[a : a + step], table, polytopes, most) for a in range(0, len(x), step)])
    code, gain = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for part, d in enumerate(polytopes):
        axis = signed(rotated(x, table, part)[:, :d])
        gain = (gain[:, :, None] + axis[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * d) + np.arange(2 * d)).reshape(len(x), -1)
        # the best buckets have the best beginnings
        if gain.shape[1] > most:
            best = np.argpartition(-gain, most - 1, axis=1)[:, :most]
            gain, code = np.take_along_axis(gain, best, 1), np.take_along_axis(code, best, 1)
    return np.take_along_axis(code, np.argsort(-gain, axis=1, kind="stable"), 1)


def shapes(dim: int, n: int) -> list[tuple[int, ...]]:
    """Polytopes for coarse to fine buckets, down to one vector a bucket on average."""
    d = 1 << (dim - 1).bit_length()
    out, whole = [(d,)], 1
    while len(out) < 24:
        last = 1
        while last <= d:
            shape = (d,) * whole + (last,)
            if (2 * d) ** whole * 2 * last > n:
                return out
            out.append(shape)
            last *= 4 if last * 4 <= d or last == d else 2
        whole += 1
    return out


def measured(x: np.ndarray, near: list[np.ndarray], n: int, asked: int, recall: float) -> Setting:
    """The cheapest setting for ``n`` vectors and ``asked`` queries that finds ``near``, the true neighbours of the unit rows ``x``.

    ``near`` is in order of the queries' distances to their last neighbour.
    """
    d = 1 << (x.shape[1] - 1).bit_length()
    owner = np.repeat(np.arange(len(x)), [len(v) for v in near])
    found = np.concatenate(near)
    quarters = [q for q in np.array_split(np.arange(len(x)), max(1, min(4, len(x) // 16))) if np.isin(owner, q).any()]
    best = (np.inf, Setting((d,), 1, 2 * d))
    for shape in shapes(x.shape[1], n):
        most = 2 * d if len(shape) == 1 else min(PROBES, int(np.prod([2 * p for p in shape])))
        place = np.full(len(found), most)
        for table in range(TABLES):
            if ROW * (table + 1) * n > best[0]:
                break
            order, code = probes(x, table, shape, most), bucket(found, table, shape)
            hit = order[owner] == code[:, None]
            place = np.minimum(place, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
            need = 0
            for share, part in [(recall, np.ones(len(place), bool)), *((recall - SLACK, np.isin(owner, q)) for q in quarters)]:
                at = np.sort(place[part])
                need = max(need, int(at[max(0, int(np.ceil(share * len(at))) - 1)]) + 1)
            if need <= most:
                setting = Setting(shape, table + 1, need)
                copies, pairs = setting.tables * (n + need * asked), setting.tables * need * asked * n / setting.buckets
                best = min(best, (ROW * copies + PAIR * pairs, setting), key=lambda c: c[0])
    return best[1]


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of single pairs, row by row: the same wherever a pair is met."""
    return np.sqrt(((q.astype(np.float64) - v.astype(np.float64)) ** 2).sum(axis=1))


def nearest_in(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of at least the k nearest rows of ``v`` for each row of ``q``, all that tie with the last too.

    Products choose, with a margin for their rounding; the distances are exact.
    """
    if not len(q) or not len(v):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    a, b = q.astype(np.float64), v.astype(np.float64)
    norms = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    rough, margin = norms - 2 * (a @ b.T), 1e-15 * (a.shape[1] + 8) * norms
    if len(v) > k:
        i, j = np.nonzero(rough - margin <= np.partition(rough + margin, k - 1, axis=1)[:, k - 1 : k])
    else:
        i, j = np.indices(rough.shape).reshape(2, -1)
    d = _distances(q[i], v[j])
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, np.arange(len(q)))
    last = d[np.minimum(first + k - 1, np.searchsorted(i, np.arange(len(q)), "right") - 1)]
    keep = d <= last[i]
    return i[keep], j[keep], d[keep]


def distinct_vectors(vectors: DataFrame, kind: str, k: int) -> DataFrame:
    """ids (the k + 1 smallest), raw: one row for each different vector.

    Spark limits the ranks before the shuffle too, so that many equal vectors make no hot task.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite(e) & F.col("vec_id").isNotNull() & F.exists(e, lambda x: x != 0))
    order = W.partitionBy("raw").orderBy("vec_id")
    ranked = raws(rows, kind, "vec_id").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return ranked.groupBy("raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "raw")


def true_neighbours(distinct: DataFrame, sample: list[bytes], kind: str, k: int) -> DataFrame:
    """s (place in the sample), d, raw: the k nearest different vectors of each vector of the sample, itself left out, in one pass."""

    def run(batches):
        best: list[list[tuple[float, bytes]]] = [[] for _ in sample]
        for batch in batches:
            column = batch.column(0)
            for size, at in by_length(column):
                mine = [s for s, r in enumerate(sample) if len(r) == size]
                if not mine:
                    continue
                v = matrix(column.take(pa.array(at)), kind)
                q = np.frombuffer(b"".join(sample[s] for s in mine), kind).reshape(len(mine), -1)
                for i, j, d in zip(*nearest_in(q, v, k + 1), strict=True):
                    best[mine[i]].append((float(d), v[j].tobytes()))
            for s, r in enumerate(sample):
                best[s] = sorted(x for x in best[s] if x[1] != r)[:k]
        rows = [(s, d, r) for s, b in enumerate(best) for d, r in b]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.binary())], names=["s", "d", "raw"])

    found = distinct.select("raw").mapInArrow(run, "s int, d double, raw binary")
    return found.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("d", "raw"))).where(F.col("r") <= k).drop("r")


def settings(distinct: DataFrame, asked: DataFrame, kind: str, k: int, recall: float) -> dict[int, Setting]:
    """A setting for each number of bytes of the vectors; lengths that the sample lacks are searched whole."""
    sizes = {r[0]: r[1] for r in distinct.groupBy(F.length("raw")).count().collect()}
    queries = {r[0]: r[1] for r in asked.groupBy(F.length("raw")).count().collect()}
    sample = [bytes(r["raw"]) for r in asked.orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).collect()]
    rows = true_neighbours(distinct, sample, kind, k).collect()  # SAMPLE times k at most
    out = {}
    width = np.dtype(kind).itemsize
    for size in queries:
        d = 1 << (size // width - 1).bit_length()
        out[size] = Setting((d,), 1, 2 * d)
        near: dict[int, list] = {}
        for r in rows:
            if len(r["raw"]) == size:
                near.setdefault(r["s"], []).append((r["d"], bytes(r["raw"])))
        order = sorted(near, key=lambda s: max(near[s])[0])
        if order:
            turn = lambda raw: unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1))
            out[size] = measured(turn([sample[s] for s in order]), [turn([r for _, r in near[s]]) for s in order], sizes.get(size, 1), queries[size], recall)
    return out


def _hashed(rows: DataFrame, key: str, kind: str, known: dict[int, Setting], many: bool) -> DataFrame:
    """size, t, code, key, raw: each row once a table, or once for each bucket that it looks into."""
    typed = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for size, at in by_length(batch.column(1)):
                if size not in known:
                    continue
                s = known[size]
                part = batch.take(pa.array(at))
                x = unit(matrix(part.column(1), kind))
                for t in range(s.tables):
                    code = probes(x, t, s.polytopes, s.probes) if many else bucket(x, t, s.polytopes)[:, None]
                    row = np.repeat(np.arange(len(x)), code.shape[1])
                    for a in range(0, len(row), 8192):
                        w = row[a : a + 8192]
                        got = part.take(pa.array(w))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), size, np.int32)), pa.array(np.full(len(w), t, np.int32)), pa.array(code.reshape(-1)[a : a + 8192]), got.column(0), got.column(1)], names=["size", "t", "code", key, "raw"])

    return rows.select(key, "raw").mapInArrow(run, f"size int, t int, code long, {key} {typed}, raw binary")


def _blocks(hashed: DataFrame, out: str) -> DataFrame:
    return hashed.groupBy("size", "t", "code").agg(F.count(F.lit(1)).alias(out))


def _dealt(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Both sides with the block of vectors (x) and of queries (y) of their bucket; a side goes to all blocks of the other."""
    at = ["size", "t", "code"]
    large = _blocks(members, "n").join(_blocks(asked, "q"), at)
    over = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    large = materialise(large.select(*at, over("n").alias("nx"), over("q").alias("ny")).where("nx > 1 or ny > 1"), "hot-buckets")
    one = lambda c: F.coalesce(c, F.lit(1))
    cut = lambda n: F.pmod(F.xxhash64("raw"), one(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    v = members.join(large, at, "left").withColumns({"x": cut("nx")}).withColumn("y", each("ny")).select(*at, "x", "y", F.lit(1).alias("side"), "ids", "raw")
    q = asked.join(large, at, "left").withColumns({"y": cut("ny")}).withColumn("x", each("nx")).select(*at, "x", "y", F.lit(0).alias("side"), F.array("rep").alias("ids"), "raw")
    return v.unionByName(q)


def _found(dealt: DataFrame, kind: str, k: int) -> DataFrame:
    """rep, vec_id, score: the k + 1 nearest vectors of each query in each block of a bucket."""
    keys = ("size", "t", "code", "x", "y")

    def compared(group: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
        side, ids, raw = rows.column(5).to_numpy(), rows.column(6), rows.column(7)
        split = int((side == 0).sum())  # queries come first
        if split in (0, len(side)):
            return None
        q, v = matrix(raw.slice(0, split), kind), matrix(raw.slice(split), kind)
        reps = ids.slice(0, split).flatten().to_numpy()
        per, flat = ids.slice(split).value_lengths().to_numpy(), ids.slice(split).flatten().to_numpy()
        begin = np.cumsum(per) - per
        out = []
        for a in range(0, split, 512):
            i, j, d = nearest_in(q[a : a + 512], v, k + 1)
            row = np.repeat(np.arange(len(i)), per[j])
            vec = flat[np.arange(len(row)) - np.repeat(np.cumsum(per[j]) - per[j], per[j]) + begin[j][row]]
            i, d = i[row], d[row]
            order = np.lexsort((vec, d, i))
            i, vec, d = i[order], vec[order], d[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
            out.append((reps[a + i[keep]], vec[keep], d[keep]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "vec_id", "score"])

    def run(batches):
        group, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if at is not None and tuple(key[a]) != at:
                    if (done := compared(group)) is not None:
                        yield done
                    group = []
                at = tuple(key[a])
                group.append(batch.slice(a, b - a))
        if group and (done := compared(group)) is not None:
            yield done

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "rep long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found of each query, its own id left out.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding.
    """
    kind = "<f4" if kind_of(vectors) == kind_of(queries) == "<f4" else "<f8"
    distinct = materialise(distinct_vectors(vectors.select("vec_id", "embedding"), kind, k), "vectors")
    e = F.col("embedding")
    wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where(finite(e) & F.col("query_id").isNotNull() & F.exists(e, lambda x: x != 0))
    wanted = materialise(raws(wanted, kind, "query_id").distinct(), "queries")
    asked = materialise(wanted.select("raw").distinct().select(F.monotonically_increasing_id().alias("rep"), "raw"), "asked")
    known = settings(distinct, asked, kind, k, recall)
    found = _found(_dealt(_hashed(distinct, "ids", kind, known, False), _hashed(asked, "rep", kind, known, True)), kind, k)
    best = W.partitionBy("rep").orderBy("score", "vec_id")
    once = found.groupBy("rep", "vec_id").agg(F.min("score").alias("score"))
    top = materialise(once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "found")
    mine = materialise(wanted.join(asked, "raw").select("query_id", "rep"), "reps")
    each = mine.join(top, "rep").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
