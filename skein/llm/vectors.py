"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors are ordered lexicographically by the concatenated bits of
random projections and compared, in double precision, with a bounded number of
followers; verified pairs of all passes are united into components. A bit tells on which
side of the median of a sample a projection lies, so that the order spreads vectors
that share a common direction too. Passes go on until, of pairs made at the threshold by
turning each vector of the sample towards one near it, the stated share has the same
leading bits in some pass, in dense regions as in sparse ones; so the number follows how
the vectors lie. Where more vectors share
these bits than a window holds, all of them are compared in blocks. As not every pair is
met, all pairs inside a component are then compared in blocks: that gives every link of
its vectors. The sample decides on the order and the number of passes, never on a link.

Equal vectors are collapsed before the passes and counted after them.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't link; a null vec_id
links with nothing; repeated rows are vectors of their own; a vec_id that occurs with
different vectors has all their links; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import materialise, pick
from skein.llm.components import components

THRESHOLD = 0.9
WINDOW = 32
BITS = 60
RECALL = 0.95
BLOCK = 2048  #: vectors of a component compared with as many others by one task
ROWS = 512  #: of these at once
SEED = 11
SAMPLE = 2048  #: vectors that the driver sees for the medians and the number of passes
NEAR = 16  #: rank of the neighbour in the sample towards which a vector is turned


def signs_for(n: int, window: int = WINDOW) -> float:
    """Leading signs that leave half a window of n evenly spread vectors."""
    return max(1.0, math.log2(max(n, 2) / (window / 2)))


def _plane(dim: int, p: int) -> np.ndarray:
    """The projections of pass ``p``, the same on every machine."""
    return np.random.default_rng([SEED, dim, p]).standard_normal((dim, BITS))


def plan(sample: list[bytes], kind: str, threshold: float, signs: int, recall: float) -> tuple[int, dict[int, np.ndarray]]:
    """The number of passes, and for each length of raw vectors the medians by pass and bit.

    At least four passes; lengths that the sample lacks are cut at 0.
    """
    groups = {}
    for size in sorted({len(r) for r in sample}):
        x = _unit([r for r in sample if len(r) == size], kind)
        near = x @ x.T
        near[near > threshold] = -2
        near[np.diag_indices(len(x))] = -2
        mate = np.argsort(-near, axis=1, kind="stable")[:, min(NEAR, len(x)) - 1]
        side = x[mate] - near[np.arange(len(x)), mate][:, None] * x
        far = np.flatnonzero((near[np.arange(len(x)), mate] > -2) & (np.linalg.norm(side, axis=1) > 1e-6))
        far = far[np.argsort(near[far, mate[far]], kind="stable")]  # from sparse regions to dense ones
        mate = threshold * x[far] + math.sqrt(1 - threshold**2) * side[far] / np.linalg.norm(side[far], axis=1, keepdims=True)
        groups[size] = (x, mate, far, np.zeros(len(far), bool), [])

    def enough() -> bool:
        return all(part.sum() >= recall * len(part) for g in groups.values() for part in np.array_split(g[3], max(1, min(4, len(g[3]) // 64))))

    passes = 0
    while passes < 4 or not enough():
        for x, mate, far, met, cuts in groups.values():
            plane = _plane(x.shape[1], passes)
            at = x @ plane
            cuts.append(np.median(at, axis=0))
            met |= (((at[far] > cuts[-1]) == (mate @ plane > cuts[-1]))[:, :signs]).all(axis=1)
        passes += 1
    return passes, {size: np.array(g[4]) for size, g in groups.items()}


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n items reaches by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def classes(rows: DataFrame) -> DataFrame:
    """One row for each different usable vector: k (its digest), rep (smallest vec_id), copies, raw (its bytes), dim."""
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    one = rows.where("usable").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))

    def run(batches):
        for batch in batches:
            raw = [np.array(e, kind).tobytes() for e in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(raw, pa.binary())], names=["k", "rep", "copies", "raw"])

    return one.mapInArrow(run, "k string, rep long, copies long, raw binary")


def _orders(distinct: DataFrame, passes: int, cuts: dict[int, np.ndarray], kind: str) -> DataFrame:
    """pass, dim, code, rep, raw: every vector once a pass with its bits as one number."""

    def run(batches):
        planes: dict[int, list[np.ndarray]] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            raws = np.array(batch.column(1).to_pylist(), object)
            sizes = np.array([len(r) for r in raws], int) if len(raws) else np.array([], int)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = _unit(list(raws[at]), kind)
                if dim not in planes:
                    planes[dim] = [_plane(x.shape[1], p) for p in range(passes)]
                cut = cuts.get(int(dim), np.zeros((passes, BITS)))
                rep = batch.column(0).take(pa.array(at))
                for p in range(passes):
                    code = ((x @ planes[dim][p]) > cut[p]) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(code), rep, pa.array(list(raws[at]), pa.binary())], names=["pass", "dim", "code", "rep", "raw"])

    return distinct.select("rep", "raw").mapInArrow(run, "pass int, dim int, code long, rep long, raw binary")


def _windows(ordered: DataFrame, kind: str, threshold: float, window: int) -> DataFrame:
    """Links within windows as (a, b), and each task's first and last rows, for the borders, as (border, place, ...)."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int32()), ("place", pa.int32()), ("run", pa.int64()), ("raw", pa.binary())])

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[tuple[int, int, bytes]] = []  # (pass and dim, rep, raw) of the last rows
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = (batch.column(0).to_numpy().astype(np.int64) << 32) + batch.column(1).to_numpy()
            rows = list(zip(runs.tolist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            if seen < window:
                first = rows[: window - seen]
                yield pa.RecordBatch.from_arrays([pa.array([None] * len(first), pa.int64()), pa.array([r[1] for r in first]), pa.array([part] * len(first), pa.int32()), pa.array(range(seen, seen + len(first)), pa.int32()), pa.array([r[0] for r in first]), pa.array([r[2] for r in first], pa.binary())], schema=out)
            seen += len(rows)
            rows = held + rows
            runs = np.array([r[0] for r in rows])
            reps = np.array([r[1] for r in rows])
            pairs = []
            for r in np.unique(runs):
                at = np.flatnonzero(runs == r)
                x = _unit([rows[i][2] for i in at], kind)
                for shift in range(1, min(window, len(at) - 1) + 1):
                    hit = np.flatnonzero(np.einsum("ij,ij->i", x[shift:], x[:-shift]) >= threshold)
                    pairs.append((at[hit], at[hit + shift]))
            if pairs:
                i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
                label = _roots(len(rows), i, j)
                at = np.flatnonzero(reps != reps[label])
                none = pa.nulls(len(at), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[label[at]]), none, none, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())], schema=out)
            held = rows[-window:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(held), pa.int64()), pa.array([r[1] for r in held]), pa.array([part + 1] * len(held), pa.int32()), pa.array(range(-len(held), 0), pa.int32()), pa.array([r[0] for r in held]), pa.array([r[2] for r in held], pa.binary())], schema=out)

    return ordered.mapInArrow(run, "a long, b long, border int, place int, run long, raw binary")


def _borders(found: DataFrame, kind: str, threshold: float, window: int) -> DataFrame:
    """Links between the last rows of a task and the first of the next: at most two windows of rows a group."""

    def run(rows):
        import pandas as pd

        out = []
        for _, same in rows.groupby("run"):
            tail, head = same[same["place"] < 0], same[same["place"] >= 0]
            if len(tail) and len(head):
                hit = (_unit(list(tail["raw"]), kind) @ _unit(list(head["raw"]), kind).T) >= threshold
                near = head["place"].to_numpy()[None, :] - tail["place"].to_numpy()[:, None] <= window
                i, j = np.nonzero(hit & near)
                out.append(pd.DataFrame({"a": tail["b"].to_numpy()[i], "b": head["b"].to_numpy()[j]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    return found.where("border is not null").groupBy("border").applyInPandas(run, "a long, b long")


def _crowded(orders: DataFrame, signs: int, kind: str, threshold: float, window: int) -> DataFrame:
    """Links as (a, b) between vectors that share their leading signs in a pass with more than a window of others."""
    run = F.concat_ws(" ", "pass", "dim", F.shiftright("code", BITS - signs)).alias("component")
    sizes = orders.select(run).groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > window + 1)
    rows = orders.select(run, "rep", F.lit(1).cast("long").alias("copies"), "raw").join(materialise(sizes, "crowded"), "component")
    return _compared(rows.select("component", "size", "rep", "copies", "raw"), kind, threshold, True).distinct()


def _links(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """rep, n: the vectors that each is linked with inside its component."""
    return _compared(members, kind, threshold, False).groupBy("rep").agg(F.sum("n").alias("n"))


def _compared(members: DataFrame, kind: str, threshold: float, edges: bool) -> DataFrame:
    """All pairs inside a component, by pairs of blocks: edges that unite what is linked as (a, b), or each one's links as (rep, n).

    ``members`` has component, size (different vectors in it), rep, copies, raw.
    """
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = members.withColumn("_b", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("component", F.least("_b", "_o").alias("x"), F.greatest("_b", "_o").alias("y"), (F.col("_b") <= F.col("_o")).alias("first"), (F.col("_b") == F.col("_o")).alias("own"), "rep", "copies", "raw")

    def flush(group):
        own = group[0][4]
        a = [r for r in group if r[3]]
        b = a if own else [r for r in group if not r[3]]
        if not a or not b or own and len(a) < 2:
            return None
        hit = np.zeros((len(a), len(b)), bool)
        u, v = [len(r[7]) for r in a], [len(r[7]) for r in b]
        for dim in set(u) & set(v):
            i, j = (np.flatnonzero(np.array(s) == dim) for s in (u, v))
            x, y = _unit([a[k][7] for k in i], kind), _unit([b[k][7] for k in j], kind).T
            for at in range(0, len(i), ROWS):
                hit[np.ix_(i[at : at + ROWS], j)] = x[at : at + ROWS] @ y >= threshold
        if own:
            np.fill_diagonal(hit, False)
        reps = [r[5] for r in a] + ([] if own else [r[5] for r in b])
        if edges:
            i, j = np.nonzero(hit)
            label = _roots(len(reps), i, j if own else j + len(a))
            low = np.array(reps)
            at = np.flatnonzero(low != low[label])
            return pa.RecordBatch.from_arrays([pa.array(low[at], pa.int64()), pa.array(low[label[at]], pa.int64())], names=["a", "b"])
        n = hit @ np.array([r[6] for r in b])
        n = n if own else np.concatenate([n, hit.T @ np.array([r[6] for r in a])])
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(n, pa.int64())], names=["rep", "n"])

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    if (done := flush(group)) is not None:
                        yield done
                    group = []
                group.append(row)
        if group and (done := flush(group)) is not None:
            yield done

    dealt = rows.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    return dealt.mapInArrow(run, "a long, b long" if edges else "rep long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(e, lambda x: x != 0)
    rows = pick(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    rows = rows.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~bad, F.lit(False)))
    rows = rows.withColumn("k", F.when(F.col("usable"), F.md5(e.cast("string"))))
    distinct = materialise(classes(rows), "vectors")
    n = distinct.count()
    signs = math.floor(signs_for(n, window))
    sample = distinct.select("rep", "raw").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("raw").toArrow().column("raw").to_pylist()
    orders = _orders(distinct, *plan(sample, kind, threshold, signs, recall), kind)
    order = ("pass", "dim", "code", "rep")
    ordered = orders.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(_windows(ordered, kind, threshold, window), "windows")
    edges = found.where("border is null").select("a", "b").unionByName(_borders(found, kind, threshold, window))
    crowded = materialise(_crowded(orders, signs, kind, threshold, window), "crowded_links")
    label = components(edges.unionByName(crowded))
    grouped = distinct.join(label, distinct["rep"] == label["node"]).select("component", "rep", "copies", "raw")
    grouped = materialise(grouped, "members")
    sizes = materialise(grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    links = _links(grouped.join(sizes, "component").select("component", "size", "rep", "copies", "raw"), kind, threshold)
    facts = distinct.select(F.col("k").alias("_k"), "rep", "copies").join(links, "rep", "left").join(label, F.col("rep") == F.col("node"), "left")
    facts = materialise(facts.select("_k", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c")), "facts")
    done = rows.select("vec_id", "k").join(facts, F.col("k") == F.col("_k"), "left")
    component = F.coalesce("_c", "vec_id")
    return done.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
