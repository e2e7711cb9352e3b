"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
PIECE = 4096  #: rows made from one array at most


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where it is unset and Spark runs on one machine a temporary folder is made and set;
    on a cluster that raises ValueError, as other machines would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{scratch(spark)}/skein/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    It cuts the lineage (a lost executor costs no recomputation of what came
    before) and drops the known partitioning, so that a join with the table
    gets exchanges that adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` wrote, once nothing reads it."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/skein/" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, actions send so many rows at once to Python workers: for rows that hold large binaries."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated(df: DataFrame, times: str, out: str) -> DataFrame:
    """Each row ``times`` (a column of 1 or more) times, numbered from 0 in ``out``; in two levels, so that no array is long."""
    n, block = F.col(times), F.col("_block")
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / PIECE))))
    return blocks.withColumn(out, F.explode(F.sequence(block * PIECE, F.least(n, (block + 1) * PIECE) - 1))).drop("_block")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that extra ones of a caller can't clash with those made here."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def id_hash(*cols: Column) -> Column:
    """Hex MD5 of the values, the same in any SQL engine; nulls count as empty."""
    return F.md5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)))
