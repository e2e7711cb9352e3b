"""Hard negatives by a two-dimensional block matrix product (SUMMA style).

The scores of anchors by rows are the product of two integer matrices. Both are cut into
blocks of rows and chunks of dimensions, and dealt over a grid: a cell gets some blocks
of anchors and some of rows, of one chunk, and multiplies each with each to partial tiles of
integer scores. The partial tiles of one place are shuffled together and added in int64; of a
finished tile only the best of each anchor and window leave the task, merged over its tiles.

Two products are made. The first is of the anchors with the rows of their own label; it
gives each anchor's positives. The second is of all anchors with all rows: each pair of
anchor and positive is a window of scores, in which the best rows of other labels are kept.
Blocks and cells are of one size whatever the labels are, so that a label that holds a
third of all rows is many tiles too.

Scores are exact: chunks are multiplied in double precision where all sums stay below
2**53, else in int64; a partial score beyond int64 is an error.

Defined results: rows with a null id, a null label, a null vector, or null or non-finite
components take no part; vectors of different lengths aren't compared; an id that is
repeated stands for its row with the smallest label, of these for that with the smallest
bytes; an anchor without positives and a window without rows give nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.arrays import matrix, packed
from skein.llm.common import batches_of, materialise

ROWS, ANCHORS = 2048, 256  #: of a block
CHUNK = 32  #: dimensions of a chunk
CELL = 8  #: blocks of anchors, and of rows, in a cell of the grid
SPREAD = 16  #: tasks that the tiles of one block of anchors are added by
LARGE = 8  #: rows that hold a block or tile in a batch
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them, so that less is shuffled."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max))


def _ints(rows: DataFrame) -> DataFrame:
    """id, label, anchor, raw (the components as int64), dim of the rows that take part."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed(batch.column(3), "<i8")], names=["id", "label", "anchor", "raw"])

    x = F.col("x")
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull()), F.lit(False)))
    usable = usable.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), x.cast("array<long>").alias("x"))
    return usable.mapInArrow(run, "id long, label long, anchor boolean, raw binary").withColumn("dim", (F.length("raw") / 8).cast("int"))


def _cut(rows: DataFrame, chunk: int) -> DataFrame:
    """Blocks cut by dimensions: g, dim, block, others, chunk, width, item, x, and with chunk 0 the block's ids, labels, bounds.

    ``rows`` has g, dim, block, others (blocks of the other matrix), id, label, raw, bounds.
    The rows of an id are in one block, where the first is kept.
    """
    keys = ("g", "dim", "block")

    def flush(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        first = np.flatnonzero(np.diff(t.column(4).to_numpy(), prepend=t.column(4)[0].as_py() - 1) != 0)  # in order of ids
        t = t.take(pa.array(first))
        x = matrix(t.column(6), "<i8")
        for c in range(-(-x.shape[1] // chunk)):
            part = _narrow(np.ascontiguousarray(x[:, c * chunk : (c + 1) * chunk]))
            lists = [pa.array([t.column(k).to_pylist() if c == 0 else None], kind) for k, kind in ((4, pa.list_(pa.int64())), (5, pa.list_(pa.int64())), (7, pa.list_(pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays([*t.slice(0, 1).columns[:4], pa.array([c], pa.int32()), pa.array([part.shape[1]], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([part.tobytes()], pa.binary()), *lists], names=["g", "dim", "block", "others", "chunk", "width", "item", "x", "ids", "labels", "bounds"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if at is not None and tuple(key[a]) != at:
                    yield from flush(held)
                    held = []
                at = tuple(key[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held)

    dealt = rows.select(*keys, "others", "id", "label", "raw", "bounds").repartition(*keys).sortWithinPartitions(*keys, "id", "label", "raw")
    return dealt.mapInArrow(run, "g long, dim int, block int, others int, chunk int, width int, item int, x binary, ids array<long>, labels array<long>, bounds array<array<long>>")


def blocks(anchors: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Both matrices in blocks, by groups; a block knows how many the other matrix has in its group.

    ``anchors`` has g, dim, id, label, raw, bounds, ``rows`` g, dim, id, label, raw.
    """
    at = ["g", "dim"]
    count = lambda t, size, out: t.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(out))
    counts = materialise(count(anchors, ANCHORS, "na").join(count(rows, ROWS, "nb"), at), "blocks")
    deal = lambda t, own, others: t.join(counts, at).withColumn("block", F.pmod(F.xxhash64("id"), own).cast("int")).withColumn("others", F.col(others))
    none = F.lit(None).cast("array<long>")
    return tuple(materialise(_cut(t, chunk), name) for t, name in ((deal(anchors, "na", "nb"), "anchor-blocks"), (deal(rows.withColumn("bounds", none), "nb", "na"), "row-blocks")))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of integer matrices."""
    most = a.shape[1] * max(1, int(np.abs(a.astype(np.int64)).max())) * max(1, int(np.abs(b.astype(np.int64)).max()))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("a score exceeds 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """g, dim, i, j, chunk, item, t (a partial tile), and with chunk 0 what both blocks hold."""
    cells = lambda n: F.ceil(F.col(n) / F.lit(CELL)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), cells(n) - 1))
    own = F.floor(F.col("block") / F.lit(CELL)).cast("int")
    a = anchors.withColumn("ci", own).withColumn("cj", each("others")).select("g", "dim", "chunk", "ci", "cj", F.col("block").alias("i"), "width", F.col("item").alias("ai"), F.col("x").alias("a"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), "bounds")
    b = rows.withColumn("cj", own).withColumn("ci", each("others")).select("g", "dim", "chunk", "ci", "cj", F.col("block").alias("j"), F.col("item").alias("bi"), F.col("x").alias("b"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"))
    head = ["g", "dim", "i", "j", "chunk", "a_ids", "a_labels", "bounds", "b_ids", "b_labels"]
    pairs = a.join(b, ["g", "dim", "chunk", "ci", "cj"]).select(*head, "width", "ai", "bi", "a", "b")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                width, ai, bi, x, y = (row.column(len(head) + c)[0].as_py() for c in range(5))
                t = _narrow(product(np.frombuffer(x, f"<i{ai}").reshape(-1, width), np.frombuffer(y, f"<i{bi}").reshape(-1, width)))
                yield pa.RecordBatch.from_arrays([*row.columns[: len(head)], pa.array([t.itemsize], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=[*head, "item", "t"])

    return pairs.mapInArrow(run, "g long, dim int, i int, j int, chunk int, a_ids array<long>, a_labels array<long>, bounds array<array<long>>, b_ids array<long>, b_labels array<long>, item int, t binary")


class _Best:
    """The k best (score, id) of each anchor of a block and each of its windows, over tiles."""

    def __init__(self, k: int, allowed: Callable):
        self.k, self.allowed, self.ids, self.score, self.row = k, allowed, None, None, None

    def add(self, ids, labels, bounds, b_ids, b_labels, tile):
        if self.ids is None:
            self.ids, width = ids, max(len(w) for w in bounds) // 2
            self.bounds = np.array([w + [1, 0] * (width - len(w) // 2) for w in bounds], np.int64).reshape(len(ids), width, 2)
            self.score = np.full((len(ids), width, self.k), LEAST)
            self.row = np.full(self.score.shape, MOST)
        tile = np.where(self.allowed(ids[:, None], labels[:, None], b_ids[None, :], b_labels[None, :]), tile, LEAST)
        order = np.argsort(-tile, axis=1, kind="stable")  # the columns are in order of ids
        best = np.take_along_axis(tile, order, 1)
        for w in range(self.bounds.shape[1]):
            low, high = self.bounds[:, w, :1], self.bounds[:, w, 1:]
            place = (best > high).sum(axis=1)[:, None] + np.arange(self.k)
            inside = place < tile.shape[1]
            place = np.minimum(place, tile.shape[1] - 1)
            score = np.take_along_axis(best, place, 1)
            inside &= (score >= low) & (score <= high) & (score > LEAST)
            score = np.concatenate([self.score[:, w], np.where(inside, score, LEAST)], axis=1)
            row = np.concatenate([self.row[:, w], np.where(inside, b_ids[np.take_along_axis(order, place, 1)], MOST)], axis=1)
            first = np.lexsort((row, -score), axis=1)[:, : self.k]
            self.score[:, w], self.row[:, w] = np.take_along_axis(score, first, 1), np.take_along_axis(row, first, 1)

    def rows(self):
        i, w, k = np.nonzero(self.score > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(w, pa.int32()), pa.array(self.row[i, w, k]), pa.array(self.score[i, w, k])], names=["anchor_id", "place", "id", "score"])


def best_in_windows(anchors: DataFrame, rows: DataFrame, k: int, allowed: Callable, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, place, id, score: the k best rows of each anchor's windows among those ``allowed`` (anchor ids, labels, row ids, labels).

    ``anchors`` has a list of bounds, a low and a high score for each window (``place``).
    """
    keys = ("g", "dim", "i", "s")

    def run(batches):
        state = at = place = held = total = None
        for batch in batches:
            for n_row in range(batch.num_rows):
                r = {n: batch.column(c)[n_row].as_py() for c, n in enumerate(batch.schema.names)}
                if place is not None and (at, r["j"]) != (tuple(r[c] for c in keys), place):
                    state.add(*held, total)
                    place = None
                if at != tuple(r[c] for c in keys):
                    if state is not None:
                        yield state.rows()
                    state, at = _Best(k, allowed), tuple(r[c] for c in keys)
                if place is None:
                    place, total = r["j"], 0
                    held = [np.array(r["a_ids"]), np.array(r["a_labels"]), r["bounds"], np.array(r["b_ids"]), np.array(r["b_labels"])]
                total = total + np.frombuffer(r["t"], f"<i{r['item']}").reshape(len(held[0]), len(held[3])).astype(np.int64)
        if state is not None:
            state.add(*held, total)
            yield state.rows()

    with batches_of(anchors.sparkSession, LARGE):
        parts = tiles(*blocks(anchors, rows, chunk)).withColumn("s", F.pmod("j", F.lit(SPREAD)))
        dealt = parts.repartition(*keys).sortWithinPartitions(*keys, "j", "chunk")
        found = materialise(dealt.mapInArrow(run, "anchor_id long, place int, id long, score long"), "tile-bests")
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, label, anchor (boolean) and x (integers). A row's score is its inner
    product with the anchor. An anchor's positives are its best other rows of the same
    label; a positive's negatives are the best rows of other labels whose score is between
    ``low`` and ``high`` per cent of the positive's.
    """
    used = materialise(_ints(rows.select("id", "label", "anchor", "x")), "rows")
    # an id that is repeated is an anchor if any of its rows is
    chosen = materialise(used.where("anchor").select("id").distinct(), "anchors")
    asked = materialise(used.join(chosen, "id", "left_semi").select("dim", "id", "label", "raw"), "asked")
    first = F.row_number().over(W.partitionBy("id").orderBy("label", "raw"))
    asked = asked.withColumn("r", first).where("r = 1").drop("r")
    open_ = F.array(F.lit(LEAST + 1), F.lit(MOST))
    own = best_in_windows(asked.withColumn("g", F.col("label")).withColumn("bounds", open_), used.withColumn("g", F.col("label")).select("g", "dim", "id", "label", "raw"), positives, lambda a, _, b, __: a != b, chunk)
    own = materialise(own.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # rounded inwards, without a product that overflows
    hundreds, rest = F.expr("(positive_score - pmod(positive_score, 100L)) div 100"), F.expr("pmod(positive_score, 100L)")
    least = low * hundreds + F.floor((low * rest + 99) / F.lit(100))
    most = high * hundreds + F.floor(high * rest / F.lit(100))
    bounds = own.groupBy("anchor_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", least.alias("l"), most.alias("h")))), lambda w: F.array(w["l"], w["h"]))).alias("bounds"))
    everyone = F.lit(0).cast("long")
    windows = materialise(asked.join(bounds, asked["id"] == bounds["anchor_id"]).select(everyone.alias("g"), "dim", "id", "label", "raw", "bounds"), "windows")
    found = best_in_windows(windows, used.select(everyone.alias("g"), "dim", "id", "label", "raw"), negatives, lambda _, a, __, b: a != b, chunk)
    found = found.select("anchor_id", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(own, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
