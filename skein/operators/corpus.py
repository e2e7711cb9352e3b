"""Corpus upkeep: what changed, what goes, duplicates, quality reports, model boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.functions import arrays as A
from skein.functions import text as X
from skein.operators import retrieval as R
from skein.sources import scratch
from skein.sources import segments as S

FINGERPRINT = ("file_name", "size", "mtime", "sha256")


def changed_files(now: DataFrame, history: DataFrame) -> DataFrame:
    """J6. Files that are new, or whose size, time or digest differ from the history."""
    return now.join(history.select(*FINGERPRINT), list(FINGERPRINT), "left_anti")


def deleted_files(now: DataFrame, history: DataFrame) -> DataFrame:
    """J8, E3. Files of the history that are no longer there."""
    return history.select("file_name").subtract(now.select("file_name"))


def kept_chunks(chunks: DataFrame, now: DataFrame, history: DataFrame) -> DataFrame:
    """J7. Chunks that are carried forward: those of unchanged files.

    The chunks of changed and deleted files go, so that no old text stays behind.
    """
    unchanged = now.join(history.select(*FINGERPRINT), list(FINGERPRINT), "left_semi").select("file_name")
    return chunks.join(unchanged, "file_name", "left_semi")


def upserted(table: DataFrame, news: DataFrame) -> DataFrame:
    """S16. Subscriptions matched by (lower-case mail, site): the name stays if the news has none, the rest is replaced whole."""
    key = lambda d: d.withColumn("email", F.lower("email"))
    t, n = key(table).alias("t"), key(news).alias("n")
    both = t.join(n, ["email", "site"], "full")
    new = F.col("n.status").isNotNull()
    columns = [F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in ("status", "plan", "expires_at")]
    return both.select("email", "site", F.coalesce("n.display_name", "t.display_name").alias("display_name"), *columns)


def _greedy(x: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Which unit rows stay, in their order: each that isn't near one that stayed before."""
    alive = np.ones(len(x), bool)
    for a in range(0, len(x), FRONT_STEP):
        part = np.flatnonzero(alive[a : a + FRONT_STEP]) + a
        own = near(x[part] @ x[part].T)
        for i in range(len(part)):
            if alive[part[i]]:
                alive[part[i + 1 :][own[i, i + 1 :]]] = False
        kept = part[alive[part]]
        behind = np.flatnonzero(alive[a + FRONT_STEP :]) + a + FRONT_STEP
        for b in range(0, len(behind), FRONT_STEP):
            some = behind[b : b + FRONT_STEP]
            alive[some[near(x[some] @ x[kept].T).any(axis=1)]] = False
    return alive


FRONT = 4096  #: items of a group that one task settles, one behind the other
FRONT_STEP = 512  #: of these multiplied at once
SPREAD = 4096  #: items behind a front that one task compares with it


def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches as one batch for each value of the first ``n`` columns."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c) for c in range(n)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in key:
            code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change |= code[1:] != code[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a].as_py() for c in key)
            if held and now != at:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            at = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_copies(items: DataFrame, by: str, key: str, vector: str, threshold: float = 0.95, inclusive: bool = False, block: int = FRONT, spread: int = SPREAD) -> DataFrame:
    """A10. Greedy removal in order: an item goes if it is too similar to one kept before; without a vector it stays.

    Unlike components, A ~ B and B ~ C but not A ~ C keeps A and C. It goes in rounds: a
    task settles the first ``block`` undecided items of a group, then all behind them
    are compared with those that stayed, spread over tasks however large the group is, and
    what is near one of them goes for good. A group of up to ``block`` items takes one
    round; a round settles ``block`` items at least, and of many alike all but one. No
    pair is ever emitted. Null groups are one group; items with equal keys come in the
    order of their vectors; vectors of different lengths aren't alike.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in (by, key)}
    near = (lambda s: s >= threshold) if inclusive else (lambda s: s > threshold)
    rows = items.select(F.col(by).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = scratch.written(A.raws(rows, "<f8", "g", "k", checked=True), "undecided")  # the items are made once
    done, left = [rows.where("raw is null").select("g", "k")], rows.where("raw is not null")
    settled = False
    schema = f"g {kinds[by]}, k {kinds[key]}, raw binary"
    own, order = W.partitionBy("g").orderBy("k", "raw"), ("k", "raw")

    def settle(batches):
        for group in _groups(batches, 1):
            keep = np.zeros(group.num_rows, bool)
            for _, at in A.by_length(group.column(2)):
                x = A.matrix(group.column(2).take(pa.array(at)), "<f8")
                x = x / np.abs(x).max(axis=1, keepdims=True)
                keep[at] = _greedy(x / np.linalg.norm(x, axis=1, keepdims=True), near)
            yield group.filter(pa.array(keep))

    def survive(batches):
        for group in _groups(batches, 2):
            side = group.column(2).to_numpy()
            head, rest = group.slice(0, int((side == 0).sum())), group.slice(int((side == 0).sum()))
            keep = np.ones(rest.num_rows, bool)
            for size, at in A.by_length(rest.column(4)):
                own_size = np.flatnonzero(A.lengths(head.column(4)) == size)
                if len(own_size):
                    y = A.matrix(head.column(4).take(pa.array(own_size)), "<f8")
                    y = y / np.abs(y).max(axis=1, keepdims=True)
                    y = (y / np.linalg.norm(y, axis=1, keepdims=True)).T
                    x = A.matrix(rest.column(4).take(pa.array(at)), "<f8")
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for a in range(0, len(at), FRONT_STEP):
                        keep[at[a : a + FRONT_STEP]] = ~near(x[a : a + FRONT_STEP] @ y).any(axis=1)
            kept = rest.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in (0, 3, 4)], names=["g", "k", "raw"])

    while True:
        left = scratch.written(left, "undecided") if settled else left
        settled = True
        sizes = scratch.written(left.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "undecided-sizes")
        # Spark limits the ranks before the shuffle too: a large group's front is what one task gets
        first = left.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= block)
        stayed = scratch.written(first.select("g", "k", "raw").repartition("g").sortWithinPartitions("g", *order).mapInArrow(settle, schema), "fronts")
        done.append(stayed.select("g", "k"))
        large = sizes.where(F.col("n") > block).select(F.col("g").alias("_g"), F.ceil((F.col("n") - block) / F.lit(spread)).cast("int").alias("blocks"))
        if not large.limit(1).count():
            break
        last = first.where(F.col("_r") == block).join(large, F.col("g").eqNullSafe(F.col("_g")))
        ends = scratch.written(last.select("_g", "blocks", F.struct("k", "raw").alias("end")), "front-ends")
        behind = left.join(ends, left["g"].eqNullSafe(ends["_g"])).where(F.struct("k", "raw") > F.col("end"))
        behind = behind.select("g", F.pmod(F.xxhash64("k", "raw"), "blocks").cast("int").alias("b"), F.lit(1).alias("side"), "k", "raw")
        heads = stayed.join(ends, stayed["g"].eqNullSafe(ends["_g"])).select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(0).alias("side"), "k", "raw")
        left = heads.unionByName(behind).repartition("g", "b").sortWithinPartitions("g", "b", "side").mapInArrow(survive, schema)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g").alias(by), F.col("k").alias(key))


def batches_of(items: DataFrame, by: str, order: str, n: int = 30) -> DataFrame:
    """A11. Numbers the batches of n items in which a model is asked about duplicates."""
    return items.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / n))


KNOWN, KNOWN_CHARS = 10_000, 8_000_000  #: texts, and characters of them, whose results a task keeps


def through_model(rows: DataFrame, column: str, model: Callable[[list[str]], list], out: str, kind: str, at_once: int = 64) -> DataFrame:
    """S13, S14. A column sent to a model in batches, equal texts near each other once; a failed text gives null.

    The model is a function from texts to results; it is sent to the tasks, so it must
    pickle and open its own connections. A task keeps the results of up to ``KNOWN`` texts,
    and of ``KNOWN_CHARS`` characters, and works on ``arrays.PIECE`` bytes at a time, so that its
    memory doesn't grow with the table.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DataType.fromDDL(kind))])
    arrow = to_arrow_schema(schema)

    def run(found: Iterator[pa.RecordBatch]):
        known: dict = {}  # a text's place in the results, which stay in Arrow, as Python's floats take four times as much
        kind = arrow.field(out).type
        results, held = pa.array([], kind), 0
        for batch in A.pieces(found):
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            new = list(dict.fromkeys(t for t in texts if t is not None and t not in known))
            got = [results]
            for i in range(0, len(new), at_once):
                part = new[i : i + at_once]
                got.append(pa.array(model(part), kind))
                if len(got[-1]) != len(part):
                    raise ValueError(f"the model gave {len(got[-1])} results for {len(part)} texts")
                known.update(zip(part, range(len(known), len(known) + len(part))))
            results = pa.concat_arrays(got)
            held += sum(map(len, new))
            yield pa.RecordBatch.from_arrays([*batch.columns, results.take(pa.array([known.get(t) for t in texts], pa.int64()))], schema=pa.schema([*batch.schema, arrow.field(out)]))
            if len(known) > KNOWN or held > KNOWN_CHARS:
                known.clear()
                results, held = pa.array([], kind), 0

    return rows.mapInArrow(run, schema)


def memoised(rows: DataFrame, column: str, model: Callable[[list[str]], list], out: str, kind: str, path: str, name: str, at_once: int = 64) -> DataFrame:
    """S10, S13. As ``through_model``, with a table below ``path`` of the results so far: each different text is sent once.

    The table has a row for each text that the model (``name``) gave a result for, by the
    text's SHA-256. Texts that it lacks are sent, once each however many rows hold them, and
    their results added as a segment; a failed text gives null, isn't kept and is sent
    again by the next run. ``compact_memo`` makes one segment of all.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.lit(name + "\x00"), column), 256))
    texts = hashed.where(F.col(column).isNotNull()).groupBy("_h").agg(F.any_value(column).alias("_text"))
    version, entries = S.read(spark, path)
    known = memo(spark, path, kind)
    sent = through_model(texts.join(known.select("_h"), "_h", "left_anti"), "_text", model, "_value", kind, at_once)
    segment, folder = S.new_segment(path)
    sent.where("_value is not null").select("_h", "_value").write.parquet(folder)
    S.commit(spark, path, version, [*entries, {"segment": segment}])
    known = memo(spark, path, kind).withColumnsRenamed({"_h": "_k"})
    return hashed.join(known, F.col("_h") == F.col("_k"), "left").withColumnRenamed("_value", out).drop("_h", "_k")


def memo(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """_h, _value: what the memo below a path holds, one row a text."""
    _, entries = S.read(spark, path)
    schema = f"_h string, _value {kind}"
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(S.folder(path, e) for e in entries))


def compact_memo(spark: SparkSession, path: str, kind: str) -> int:
    """Makes one segment of a memo's; readers of the older version keep theirs until ``segments.forget``."""
    version, entries = S.read(spark, path)
    segment, folder = S.new_segment(path)
    memo(spark, path, kind).repartitionByRange("_h").sortWithinPartitions("_h").write.parquet(folder)
    return S.commit(spark, path, version, [{"segment": segment}])


def hashed_embedding(dim: int = 64) -> Callable[[list[str]], list]:
    """A stand-in for an embedding model: normalised counts of hashed words, the same on every machine."""
    import zlib

    def embed(texts: list[str]) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % dim] += 1
            out.append((v / n).tolist() if (n := np.linalg.norm(v)) else None)
        return out

    return embed


def corruption(docs: DataFrame, by: str, unsafe: Column) -> DataFrame:
    """A7. Rate and number of corrupted texts by group."""
    flag = (F.size(unsafe) > 0).cast("int")
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("corrupted"), F.avg(flag).alias("rate"))


def character_frequency(docs: DataFrame, unsafe: Column, n: int = 20) -> DataFrame:
    """A7. The characters that are found in most texts."""
    return docs.select(F.explode(unsafe).alias("character")).groupBy("character").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "character").limit(n)


def unseen(items: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """E4. Items whose text wasn't seen before, each text once."""
    rows = items.withColumn("md5", F.md5(text))
    return rows.join(seen.select("md5"), "md5", "left_anti").dropDuplicates(["md5"])


def chunk_counts(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """A2. Chunks of each document."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))


def corpus_statistics(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """A1. Documents, chunks, chunks a document, and tokens of a table of chunks (key, text).

    Chunks are summed up by document and then in all, so that no distinct count is needed.
    """
    t = X.tokens(F.col("text"))
    each = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("t"), F.min(t).alias("low"), F.max(t).alias("high"))
    return each.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chunks"), F.avg("n").alias("chunks_per_document"), (F.sum("t") / F.sum("n")).alias("mean_tokens"), F.min("low").alias("least_tokens"), F.max("high").alias("most_tokens"))


def report_summary(report: DataFrame) -> DataFrame:
    """A9. One row on a report (status, chunks): how many files, how many failed or were split, and chunks."""
    of = lambda s: F.count_if(F.col("status") == s)
    return report.agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"), of("failed").alias("failed"), of("split").alias("split"), F.sum(F.when(F.col("status") == "ok", F.col("chunks")).otherwise(0)).alias("ok_chunks"))


def failures(report: DataFrame) -> DataFrame:
    """A9. The failed files of a report, as rows."""
    return report.where("status = 'failed'")


def point_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """S15. The row with a key, at most one; the filter reaches the scan."""
    return rows.where(F.col(key) == value).limit(1)


def picked(choices: Column, key: str) -> Column:
    """K7. One of an array's choices for each key, the same on every run and in every engine with MD5."""
    n = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("long")
    return F.element_at(choices, (n % F.size(choices) + 1).cast("int"))


def every_nth(rows: DataFrame, key: str, n: int, *ties: str, run: int = 4096) -> DataFrame:
    """K8. Every n-th row in the order of its key, then ``ties``, beginning with the first; null keys stand last.

    Places by two passes, so that no task orders all rows: counts by runs of keys, then places inside a run.
    """
    placed = rows.withColumn("_r", F.floor(F.col(key) / run))
    counts = placed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each run of keys
    before = counts.select("_r", F.coalesce(F.sum("_n").over(W.orderBy(F.asc_nulls_last("_r")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy("_r").orderBy(F.asc_nulls_last(key), *ties)) - 1
    found = placed.withColumn("_i", inside).join(before, placed["_r"].eqNullSafe(before["_r"]))
    return found.where((F.col("_base") + F.col("_i")) % n == 0).select(*rows.columns)


def with_default(rows: DataFrame, known: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """J2. Rows with a column looked up by key; the default where there is none."""
    return rows.join(known, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))
