"""Tables between the steps of a query, in the folder that the cluster shares."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="skein-")


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves on one machine; on a cluster it
    raises ValueError, as other machines would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _local()
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared(spark)}/skein/{name}-{uuid.uuid4().hex[:12]}"


def kept(spark: SparkSession, source: str, name: str, make: Callable[[str], object]) -> str:
    """The path of what ``make`` writes from a source, made once for the files that the source has now.

    Names, sizes and times of the source's files decide whether it is made anew. It is written
    apart and renamed when it is whole, so that a reader never sees a part of it.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    files = hadoop(source).getFileSystem(conf).listFiles(hadoop(source), True)
    marks = []
    while files.hasNext():
        f = files.next()
        marks.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    path = f"{shared(spark)}/skein/kept/{name}-{hashlib.md5(' '.join(sorted(marks)).encode()).hexdigest()}"
    fs = hadoop(path).getFileSystem(conf)
    if not fs.exists(hadoop(path)):
        make(part := folder(spark, name))
        fs.mkdirs(hadoop(path).getParent())
        if not fs.exists(hadoop(path)):
            fs.rename(hadoop(part), hadoop(path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read back, for results that are used several times."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
