"""Sources: text, binary documents, listings, question-answer files, snapshots."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes by kind of document. Fixed values.
SUFFIXES = {"pdf": ("pdf",), "word": ("docx", "doc"), "text": ("txt", "md", "csv", "json")}


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """S6, S19. path, file_name, stem, size, mtime: no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select("path", name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """S3. A row for each whole file, bytes that aren't UTF-8 left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select("path", text.alias("text"))


def _word(content: bytes) -> str:
    """S2. The paragraphs of a .docx, blank ones left out, with a blank line between."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def _pdf(content: bytes) -> str:
    """S1. The pages of a PDF behind [Page n] marks; needs the optional pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    return "\n".join(f"[Page {i}]\n{p.extract_text()}" for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1))


def extracted(content: bytes, name: str) -> tuple[str, str | None]:
    """S4. (text, error) by suffix; an unknown one gives no text."""
    suffix = name.rpartition(".")[2].lower()
    kind = next((k for k, s in SUFFIXES.items() if suffix in s), None)
    try:
        return {"pdf": _pdf, "word": _word, "text": lambda c: c.decode("utf-8", "ignore"), None: lambda c: ""}[kind](content), None
    except Exception as e:  # noqa: BLE001  one broken file must not end the scan
        return "", f"{type(e).__name__}: {e}"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """S1 to S4. path, text, error for every file below a path, read by the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            paths, contents = (batch.column(i).to_pylist() for i in (0, 1))
            found = [extracted(c, p) for p, c in zip(paths, contents, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "text", "error"])

    return files.mapInArrow(run, "path string, text string, error string")


def pages_of(text: Column) -> Column:
    """S1. Array of (page, text) of a text with [Page n] marks."""
    parts = F.filter(F.split(text, r"(?=\[Page [0-9]+\])"), lambda x: x.rlike(r"^\[Page [0-9]+\]"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^\[Page ([0-9]+)\]", 1).cast("int").alias("page"), F.regexp_replace(x, r"^\[Page [0-9]+\]\s*|(?<!\s)\s++\z", "").alias("text")))


QA = "qa_pairs array<struct<turn:long,question:string,answer:string,context:string,source:string,page:int>>"


def qa_rows(files: DataFrame, column: str) -> DataFrame:
    """S8. The pairs of question-answer files; the answer is the context where that lacks, incomplete pairs go."""
    pairs = files.withColumn("_p", F.explode(F.from_json(column, QA)["qa_pairs"])).drop(column)
    rows = pairs.select(*(c for c in pairs.columns if c != "_p"), "_p.*")
    full = rows.where("coalesce(question, '') <> '' and coalesce(answer, '') <> ''")
    return full.withColumn("context", F.coalesce("context", "answer"))


def qa_files(spark: SparkSession, path: str) -> DataFrame:
    return qa_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "j"), "j")


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """S9, X11. The newest complete version below a path, None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    found = [s.getPath() for s in fs.listStatus(hadoop) if re.fullmatch(r"v[0-9]+", s.getPath().getName())]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    newest = max(done, key=lambda p: int(p.getName()[1:]), default=None)
    return None if newest is None else spark.read.parquet(newest.toString())
