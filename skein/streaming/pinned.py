"""X11. Snapshots that a running stream reloads: each micro-batch reads the newest version there is.

A batch's version is pinned in a file before its work begins. A batch that runs again
after a failure or a restart reads the version that it read before, so that its rows are
the same; the next batch looks for a newer one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Work = Callable[[DataFrame, DataFrame | None, int], None]


def newest(spark: SparkSession, path: str) -> int | None:
    """The number of the newest complete version below a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))]
    return max((int(n[1:]) for n in names if re.fullmatch(r"v[0-9]+", n) and fs.exists(hadoop(f"{path}/{n}/_SUCCESS"))), default=None)


def pinned_version(spark: SparkSession, path: str, pins: str, batch: int) -> int | None:
    """The version that a batch reads: the pinned one, else the newest, which is pinned then."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(pins).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(pins))
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(pins))]
    known = next((m[1] for n in names if (m := re.fullmatch(rf"batch-{batch}-v([0-9]+|none)", n))), None)
    if known is None:
        found = newest(spark, path)
        known = "none" if found is None else str(found)
        fs.createNewFile(hadoop(pins, f"batch-{batch}-v{known}"))
        for n in names:  # pins of batches that can't run again
            if (m := re.fullmatch(r"batch-([0-9]+)-v.*", n)) and int(m[1]) < batch - 1:
                fs.delete(hadoop(pins, n), False)
    return None if known == "none" else int(known)


def with_newest(path: str, pins: str, work: Work) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: ``work(batch, snapshot, number)`` with the batch's version, None before the first is published.

    ``pins`` is a folder of the query's own, as its checkpoint is.
    """

    def sink(batch: DataFrame, number: int) -> None:
        version = pinned_version(batch.sparkSession, path, pins, number)
        work(batch, None if version is None else batch.sparkSession.read.parquet(f"{path}/v{version}"), number)

    return sink
