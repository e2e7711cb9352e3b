"""Tables made of immutable segments, and the manifest that says which of them count.

A segment is a folder that is written once. A manifest is a small JSON file, one for each
version; readers take the newest, so that they see a change whole or not at all. A writer
claims the next version by making a file that must not be there yet: of two writers one
has to begin again. Nothing is deleted while readers may hold it; ``forget`` does that.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class ConcurrentChange(RuntimeError):
    """Another writer claimed the next version of the manifest."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str, suffix: str) -> list[int]:
    hadoop, fs = _fs(spark, path)
    folder = hadoop(path, "manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"v([0-9]+)\.{suffix}", n)))


def read(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """The newest version and its entries; (0, []) where there is none."""
    known = _versions(spark, path, "json")
    if not known:
        return 0, []
    hadoop, fs = _fs(spark, path)
    stream = fs.open(hadoop(path, f"manifest/v{known[-1]}.json"))
    try:
        return known[-1], json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: int, entries: list[dict]) -> int:
    """Makes ``entries`` the version after ``version``; ConcurrentChange if another writer was first.

    A claim whose writer died stays, so that no change is lost silently: ``release`` drops it.
    """
    hadoop, fs = _fs(spark, path)
    fs.mkdirs(hadoop(path, "manifest"))
    if version != max(_versions(spark, path, "json"), default=0) or not fs.createNewFile(hadoop(path, f"manifest/v{version + 1}.claim")):
        raise ConcurrentChange(f"version {version + 1} of {path} is another writer's")
    part = hadoop(path, f"manifest/_{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps(entries).encode()))
    stream.close()
    if not fs.rename(part, hadoop(path, f"manifest/v{version + 1}.json")):
        raise OSError(f"version {version + 1} of {path} couldn't be written")
    return version + 1


def release(spark: SparkSession, path: str) -> None:
    """Drops the claim of a writer that died before its version was there."""
    hadoop, fs = _fs(spark, path)
    for v in set(_versions(spark, path, "claim")) - set(_versions(spark, path, "json")):
        fs.delete(hadoop(path, f"manifest/v{v}.claim"), False)


def new_segment(path: str) -> tuple[str, str]:
    """The name and the folder of a segment that isn't there yet."""
    name = uuid.uuid4().hex
    return name, f"{path}/segments/{name}"


def folder(path: str, entry: dict) -> str:
    return f"{path}/segments/{entry['segment']}"


def forget(spark: SparkSession, path: str) -> int:
    """Deletes the segments that the newest version doesn't name, and says how many. Only when nothing reads older versions."""
    hadoop, fs = _fs(spark, path)
    live = {e["segment"] for e in read(spark, path)[1]}
    root = hadoop(path, "segments")
    gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in live] if fs.exists(root) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
