"""Sinks: versioned snapshots, reports, text exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str) -> str:
    """S9, S10. Writes the next version below a path; readers see it once it is complete.

    A version is claimed by making a file that must not be there yet, so that two writers get two versions.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))] if fs.exists(hadoop(path)) else []
    version = max((int(n[1:]) for n in names if re.fullmatch(r"v[0-9]+", n)), default=0) + 1
    while not fs.createNewFile(hadoop(path, f"_v{version}.claim")):
        version += 1
    df.write.parquet(out := f"{path}/v{version}")
    return out


def append_report(df: DataFrame, path: str) -> None:
    """S11. Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def export_lines(docs: DataFrame) -> DataFrame:
    """S12. doc_id, line: the whole texts as readable lines; backslashes and line breaks are escaped, a null text is empty."""
    text, number = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    for plain, escaped in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    line = F.concat("source", F.lit("#"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0")), F.lit(": "), text)
    return docs.withColumn("line", line)


def write_export(docs: DataFrame, path: str) -> None:
    """S12. The lines of ``export_lines`` as text files, sorted by source and id."""
    rows = export_lines(docs.select("source", "doc_id", "text")).select("source", "doc_id", "line")
    rows.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id").select("line").write.text(path)
