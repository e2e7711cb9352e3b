"""Vector code compression by Heap Lloyd.

Vectors become integers and are cut into equal parts; each part position has a codebook, and
a vector's code names the nearest entry for each part. Lloyd rounds make the codebooks: parts are
assigned, then entries become the means of theirs.

Every part keeps its slack: the distance to the second nearest entry less that to its own.
When entries move, an entry's cumulative drift grows by how far it moved and by how far
any other did. A task holds a heap of its parts for each position and entry, keyed by
slack plus the drift at the time; only parts at the top whose key the drift has reached can have
another nearest entry now, so they alone are popped and compared with all entries again.
The rest keep their entry without being looked at.

State (codes and keys) goes from round to round as a table, so that a lost executor costs its
tasks alone. Tasks give the change of sums and counts for the entries that won or lost
parts; these are added by entry, and only the codebooks, of a size that the parameters fix,
come to the driver. Comparisons are of integers: rounding decides nothing, as keys are
popped with a margin and distances that are compared are exact.

Defined results: vectors that are null, empty or hold null or non-finite components are
dropped; so are vectors whose length isn't that of the smallest id's vector, and all, where
the parts can't be equal; null ids come last in the order that begins the codebooks, equal
ids in that of their bytes; fewer vectors than entries make a smaller codebook;
repeated rows are vectors of their own; null labels are one label; an empty table gives an
empty result; a component of 2**26 or more after scaling is an error.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.functions.arrays import finite, kind_of, matrix, raws, rows_of
from skein.llm.common import batches_of, discard, materialise, pick

#: Equal parts of a vector, entries of a codebook (at most 65,536), Lloyd rounds, units a component is cut into.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 2**26  #: components stay below, so that squared distances are exact in double precision
MARGIN = 1e-6  #: by which keys are popped early, far above the rounding of distances
STEP = 2048  #: parts compared with a codebook at once


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x: the usable vectors with floor(scale * component) as int32 bytes."""
    kind = kind_of(vectors)
    rows = pick(vectors, "vec_id", "label", "embedding").where(finite(F.col("embedding")))

    def run(batches):
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: batch.num_rows + 1])
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = np.floor(matrix(part.column(2), kind).astype(np.float64) * scale)
                if np.abs(x).max() >= LARGEST:
                    raise OverflowError(f"a component of {LARGEST} or more after scaling")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows_of(x.astype("<i4"))], names=["vec_id", "label", "x"])

    types = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return raws(rows, kind, "vec_id", "label").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, x binary")


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """parts x entries x width: the parts of the vectors with the smallest ids; None where none can be cut."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("x"))
    first = rows.orderBy(*order).limit(1).select(F.length("x")).collect()
    if not first or first[0][0] // 4 % parts:
        return None
    head = rows.where(F.length("x") == first[0][0]).orderBy(*order).limit(entries).select("x").collect()
    x = np.array([np.frombuffer(bytes(r[0]), "<i4") for r in head], np.int64)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer parts from all entries."""
    a, b = x.astype(np.float64), book.astype(np.float64)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part its entry (the first of equals), its squared distance, and its slack."""
    code, own, slack = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for a in range(0, len(x), STEP):
        d = squared(x[a : a + STEP], book)
        at = d.argmin(axis=1)
        rows = np.arange(len(d))
        code[a : a + STEP], own[a : a + STEP] = at, d[rows, at]
        d[rows, at] = np.inf
        if d.shape[1] > 1:
            slack[a : a + STEP] = np.sqrt(d.min(axis=1)) - np.sqrt(own[a : a + STEP])
    return code, own, slack


def violated(code: np.ndarray, key: np.ndarray, drift: np.ndarray) -> list[int]:
    """The parts to compare again: a heap for each entry, popped down to the entry's drift."""
    out: list[int] = []
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(drift) + 1))
    for c in range(len(drift)):
        members = order[ends[c] : ends[c + 1]]
        if not len(members):
            continue
        heap = list(zip(key[members].tolist(), members.tolist(), strict=True))
        heapify(heap)
        while heap and heap[0][0] <= drift[c] + MARGIN:
            out.append(heappop(heap)[1])
    return out


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """parts x entries: how far each entry moved, and the most that any other did."""
    moved = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=2))
    if moved.shape[1] < 2:
        return moved
    top = np.sort(moved, axis=1)[:, ::-1]
    other = np.where(moved == top[:, :1], np.where(top[:, 1:2] == top[:, :1], top[:, :1], top[:, 1:2]), top[:, :1])
    return moved + other


def assigned(rows: DataFrame, books: np.ndarray, drift: np.ndarray, first: bool) -> DataFrame:
    """vec_id, label, x, code, key, moved: the rows with their parts' entries and keys; a task's last row has its changes.

    ``books`` and ``drift`` (parts x entries) are of a fixed size and go with the task. On
    the first pass all parts are compared, later those that are popped.
    """
    parts, entries, width = books.shape
    types = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        compared = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2), "<i4").astype(np.int64).reshape(batch.num_rows, parts, width)
            code = np.zeros((len(x), parts), np.uint8 if entries <= 256 else np.uint16)
            key = np.zeros((len(x), parts))
            if not first:
                code = matrix(batch.column(3), code.dtype.newbyteorder("<")).copy()
                key = matrix(batch.column(4), "<f8").copy()
            for p in range(parts):
                at = np.arange(len(x)) if first else np.array(violated(code[:, p], key[:, p], drift[p]), int)
                if not len(at):
                    continue
                compared += len(at)
                now, _, slack = nearest(x[at, p], books[p])
                was = code[at, p].astype(np.int64)
                key[at, p] = slack + drift[p][now]
                code[at, p] = now
                new = at if first else at[now != was]
                here = now if first else now[now != was]
                np.add.at(sums[p], here, x[new, p])
                np.add.at(counts[p], here, 1)
                if not first:
                    gone = was[now != was]
                    np.subtract.at(sums[p], gone, x[new, p])
                    np.subtract.at(counts[p], gone, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rows_of(code), rows_of(key), pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.int64())], names=names)
        last = [pa.nulls(1, t) for t in (*kinds, pa.binary(), pa.binary(), pa.binary())]
        change = np.concatenate([sums.reshape(-1), counts.reshape(-1)])
        yield pa.RecordBatch.from_arrays([*last, pa.array([change.tobytes()], pa.binary()), pa.array([compared], pa.int64())], names=names)

    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("vec_id", "label")]
    names = ["vec_id", "label", "x", "code", "key", "changes", "compared"]
    return rows.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, x binary, code binary, key binary, changes binary, compared long")


def changed(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """The change of all entries' sums and counts that the tasks of a pass gave, and how many parts they compared."""

    def run(batches):
        total = 0
        for batch in batches:
            for raw in batch.column(0):
                total = total + np.frombuffer(raw.as_py(), "<i8")
        at = np.flatnonzero(total) if isinstance(total, np.ndarray) else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at] if len(at) else at)], names=["i", "v"])

    rows = state.where("changes is not null")
    with batches_of(state.sparkSession, 16):
        found = rows.select("changes").mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
    for i, v in found:
        total[i] = v
    cut = shape[0] * shape[1] * shape[2]
    return total[:cut].reshape(shape), total[cut:].reshape(shape[:2]), rows.agg(F.coalesce(F.sum("compared"), F.lit(0))).collect()[0][0]


class Fitted(NamedTuple):
    """Codebooks (parts x entries x width), the vectors with their codes, and how many parts each pass compared."""

    books: np.ndarray | None
    rows: DataFrame
    compared: list[int]

    def sha256(self) -> str:
        """Of the entries' integers by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Fitted:
    """The codebooks after ``rounds`` Lloyd rounds over ``rows`` (vec_id, label, x as ``integers`` gives them), and the final codes."""
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return Fitted(None, rows.where("false"), [])
    state = rows.where(F.length("x") == 4 * parts * books.shape[2])
    sums, counts, drift = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), np.zeros(books.shape[:2])
    compared = []
    for turn in range(rounds + 1):
        new = materialise(assigned(state, books, drift, turn == 0), "codes")
        if turn:
            discard(state)
        more, won, n = changed(new, books.shape)
        compared.append(n)
        state = new.where("x is not null").drop("changes", "compared")
        if turn < rounds:
            sums, counts = sums + more, counts + won
            after = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
            drift, books = drift + drifts(books, after), after
    return Fitted(books, state, compared)


def coded(fitted: Fitted) -> DataFrame:
    """vec_id, label, code (two hex digits a part, or four), error: the exact squared distances of the parts from their entries."""
    books = fitted.books
    parts, entries, width = books.shape
    kind = np.uint8 if entries <= 256 else np.dtype("<u2")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code = matrix(batch.column(3), kind)
                x = matrix(batch.column(2), "<i4").astype(np.int64).reshape(len(code), parts, width)
                error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                text = code.astype(kind if entries <= 256 else ">u2").tobytes().hex()
                step = len(text) // len(code)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i : i + step] for i in range(0, len(text), step)]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    types = {c: fitted.rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return fitted.rows.select("vec_id", "label", "x", "code").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of ``vectors`` (vec_id, label, embedding)."""
    rows = materialise(integers(vectors, scale), "integers")
    fitted = fit(rows, parts, entries, rounds)
    if fitted.books is None:
        text = F.lit("").alias("code")
        return fitted.rows.select("vec_id", text, *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    codes = materialise(coded(fitted), "coded")
    sums = materialise(codes.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")), "label-errors")
    done = codes.join(sums, codes["label"].eqNullSafe(sums["_l"]))
    return done.select("vec_id", "code", "error", "label_error", F.lit(fitted.sha256()).alias("codebooks_sha256"))
