"""Jump consistent hashing: stable keys to shards without a ring table (native).

``jump_shard`` is the published function: a 64-bit linear congruential generator
seeded with the key, jumping forward until it passes the shard count. Appending a
shard moves only the rows that go into it. Columns and SQL functions only.

Defined results: a null key counts as key 0; a null text has no bytes (checksum 0);
repeated rows get slots of their own; an empty table gives an empty result; further
columns are left out of the manifest and kept by ``assign_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import id_hash, pick, repeated

SHARDS = 40
HEADER_BYTES = 16
#: The generator's multiplier, 2862933555777941757, as two halves. Fixed value.
MUL_HI, MUL_LO = 0x27BB2EE6, 0x87B0B0FD
MASK = 0xFFFFFFFF


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long key, 0 to ``shards`` - 1.

    The state is the 64-bit key in two halves, as products must wrap and the
    session may run in ANSI mode. Jumps go forward by one at least, so that
    ``shards`` steps always suffice; a step past the end changes nothing.
    """
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(k, 32).alias("h"), k.bitwiseAND(F.lit(MASK)).alias("l"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        lo16, hi16 = s["l"].bitwiseAND(F.lit(0xFFFF)), F.shiftright(s["l"], 16)
        t0, t1 = lo16 * MUL_LO + 1, hi16 * MUL_LO
        low = t0.bitwiseAND(F.lit(MASK)) + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16)
        carry = F.shiftright(low, 32) + F.shiftright(t0, 32) + F.shiftright(t1, 16)

        def wrapped(x: Column, y: int) -> Column:
            return F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(F.lit(0xFFFF)), 16) + x.bitwiseAND(F.lit(0xFFFF)) * y

        high = (wrapped(s["h"], MUL_LO) + wrapped(s["l"], MUL_HI) + carry).bitwiseAND(F.lit(MASK))
        leap = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(high.alias("h"), low.bitwiseAND(F.lit(MASK)).alias("l"), s["j"].alias("b"), leap.alias("j"))
        return F.when(s["j"] >= shards, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, out: str = "shard") -> DataFrame:
    """``df`` with a shard column; no shuffle."""
    return df.withColumn(out, jump_shard(F.col(f"`{key}`"), shards))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, files_per_shard: int = 8) -> None:
    """Writes ``df`` as one folder a shard; a shard is split by row hash over several tasks."""
    rows = assign_shards(df, key, shards)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(files_per_shard))
    rows.repartition(shards * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)


def shard_manifest(docs: DataFrame, shards: int = SHARDS, hex_digits: int = 3) -> DataFrame:
    """Where every document goes: its shard, its place there, and its shard if one more is appended.

    Places are gapless from 0 in each shard, in the order of a hash of the row. They
    come from two passes: counts by shard and hash prefix (at most ``shards`` x
    16^hex_digits rows), running sums over these, then places within a prefix, so
    that no task orders a whole shard. The hash is of the whole row, as many rows may
    lack an id. Equal rows are counted once and dealt out again at the end, so that a
    much repeated row isn't ordered by one task either.
    """
    payload = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(payload) + HEADER_BYTES).cast("long").alias("size"),
        F.crc32(payload).cast("long").alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    rows = assign_shards(assign_shards(rows, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    rows = rows.withColumn("_h", id_hash(F.col("doc_id"), F.col("size"), F.col("text_crc32"))).withColumn("_p", F.substring("_h", 1, hex_digits))
    totals = rows.groupBy("shard", "_p").agg(F.sum("copies").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("shard", "_p", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum("copies").over(W.partitionBy("shard", "_p").orderBy("_h", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("_in", F.coalesce(inside, F.lit(0)))
    # the totals are bounded by shards x prefixes, whatever the input
    placed = placed.join(F.broadcast(starts), ["shard", "_p"])
    return repeated(placed, "copies", "_copy").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_base") + F.col("_in") + F.col("_copy")).alias("slot"), "grown_shard")
