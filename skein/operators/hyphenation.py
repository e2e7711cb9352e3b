"""T7. Hyphenation by patterns (Liang's method), in Arrow batches of different words.

A pattern such as ``a1bc3d4`` has a weight in each gap between its letters; a full stop stands for
a word's end. All patterns that occur in a word vote for its gaps, the highest weight of a gap
counts, and odd ones allow a break. Patterns and exceptions are the caller's, of any
language. Words are taken once each, whatever the number of rows that hold them, and only they are
shuffled; the patterns, some thousands for a language, go to the tasks.

Defined results: words of up to four letters, and breaks inside the first two or last two
letters, are left alone; case is ignored and kept; a null word is left out; an
exception (``ta-ble``) is broken at its hyphens alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import arrays as A

SHORT = 4  #: words up to this length stay whole


def weights(patterns: DataFrame) -> DataFrame:
    """letters, gaps (array of weights, one more than letters) of a table of patterns."""
    gap = F.transform(F.split("pattern", r"[^0-9]", -1), lambda g: F.when(g == "", 0).otherwise(g.cast("int")))
    rows = patterns.select(F.regexp_replace("pattern", "[0-9]", "").alias("letters"), gap.alias("gaps")).where("letters <> ''")
    # a pattern that is given twice counts by its later form in order of the text
    return rows.groupBy("letters").agg(F.max("gaps").alias("gaps"))


def _breaks(known: dict[str, list[int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to (word, low) where the patterns allow a break: the letters before it."""
    sizes = sorted({len(letters) for letters in known})

    def places(low: str) -> list[int]:
        w = f".{low}."
        best = [0] * (len(w) + 1)
        for i in range(len(w)):
            for n in sizes:
                for j, weight in enumerate(known.get(w[i : i + n], ())):
                    if weight > best[i + j]:
                        best[i + j] = weight
        return [i - 1 for i, weight in enumerate(best) if weight % 2]  # the full stop in front is no letter

    def run(batches):
        for batch in A.pieces(batches):
            found = [places(low) if len(low) > SHORT else None for low in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=["word", "low", "places"])

    return run


def hyphenated(words: DataFrame, patterns: DataFrame, exceptions: DataFrame | None = None, column: str = "word") -> DataFrame:
    """word, pieces for each different word; ``patterns`` has pattern, ``exceptions`` word with hyphens."""
    word = words.select(F.col(column).alias("word")).where("word is not null").distinct().select("word", F.lower("word").alias("low"))
    known = {letters: gaps for letters, gaps in weights(patterns).collect()}
    voted = word.mapInArrow(_breaks(known), "word string, low string, places array<int>")
    if exceptions is not None:
        hyphens = exceptions.select(F.lower(F.replace("word", F.lit("-"), F.lit(""))).alias("low"), F.split("word", "-").alias("own"))
        sums = F.transform(F.slice("own", F.lit(1), F.size("own") - 1), lambda _, i: F.aggregate(F.slice(F.col("own"), F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)))
        fixed = F.when(F.size("own") > 1, sums).when(F.size("own") == 1, F.array().cast("array<int>"))
        voted = voted.join(hyphens.dropDuplicates(["low"]), "low", "left").withColumn("places", F.coalesce(fixed, "places"))
    n = F.length("word")
    inside = F.filter(F.coalesce("places", F.array().cast("array<int>")), lambda p: (p >= 2) & (p <= n - 2))
    cut = voted.select("word", F.concat(F.array(F.lit(0)), inside, F.array(n)).alias("ends"))  # a column, as each piece looks into it
    pieces = F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda a, i: F.substring(F.col("word"), a + 1, F.get("ends", i + 1) - a))
    return cut.select("word", F.when(n > SHORT, pieces).otherwise(F.array("word")).alias("pieces"))
