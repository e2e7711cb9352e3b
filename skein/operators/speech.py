"""Speech: rate from spectra, what was said in a segment, when words are due.

Samples come as frames by key; a key's frames pass through one task in order, which
holds one window of samples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import corpus

SILENCE = 0.005  #: root mean square under which a window is silent; half of it for its last three tenths


def spectral_flux(samples: np.ndarray, rate: int) -> float:
    """Mean change of the magnitudes between neighbouring spectra of 25 ms, half overlapping; 0 in silence."""
    power = samples**2
    tail = power[int(len(power) * 0.7) :]
    if not len(power) or np.sqrt(power.mean()) < SILENCE or np.sqrt(tail.mean()) < SILENCE / 2:
        return 0.0
    n = int(rate * 0.025)
    if n < 2 or len(samples) < n:
        return 0.0
    shape = np.hanning(n)
    frames = np.lib.stride_tricks.sliding_window_view(samples, n)[:: n // 2]
    found = np.abs(np.fft.rfft(frames * shape, axis=1)) / np.sqrt((shape**2).sum())
    return float(np.abs(np.diff(found, axis=0)).sum(axis=1).mean()) if len(found) > 1 else 0.0


def speaking_rates(frames: DataFrame, rate: int, window: float = 1.0, step: float = 0.1) -> DataFrame:
    """W17. (key, t, rate) for each window of the frames (key, seq, samples between -1 and 1).

    A time is the middle of its window. At a key's end a rest of more than half a window
    gives one more, its length later. Null frames hold no samples; a key with half a
    window or less gives no row.
    """
    size, hop = int(window * rate), int(step * rate)

    def run(batches):
        at, held, t = None, np.zeros(0), window / 2
        for batch in batches:
            out = []
            for key, samples in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key != at:
                    if len(held) > size / 2:
                        out.append((at, t + len(held) / rate, spectral_flux(held, rate)))
                    at, held, t = key, np.zeros(0), window / 2
                more = samples.values
                held = np.concatenate([held, np.zeros(0) if more is None else more.drop_null().to_numpy(zero_copy_only=False)])
                first = 0
                while len(held) - first >= size:
                    out.append((key, t, spectral_flux(held[first : first + size], rate)))
                    first, t = first + hop, t + step
                held = held[first:]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["key", "t", "rate"])
        if len(held) > size / 2:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((at, t + len(held) / rate, spectral_flux(held, rate)), kinds, strict=True)], names=["key", "t", "rate"])

    rows = frames.select("key", "seq", F.transform("samples", lambda x: x.cast("double")).alias("samples"))
    kinds = [pa.int64(), pa.float64(), pa.float64()]
    return rows.withColumn("key", F.col("key").cast("long")).repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, "key long, t double, rate double")


def segments(samples: DataFrame, events: DataFrame) -> DataFrame:
    """X19. The samples (key, t, ...) from a start of activity to its end, with the number of their ``segment``.

    ``events`` (key, t, event) are those of X2. A segment that hasn't ended is left out.
    """
    marks = events.groupBy("key", "t").agg(F.sum((F.col("event") == "start").cast("int")).alias("_s"), F.sum((F.col("event") == "end").cast("int")).alias("_e"))
    w = W.partitionBy("key").orderBy("t")
    rows = samples.join(marks, ["key", "t"], "left").na.fill(0, ["_s", "_e"])
    rows = rows.withColumns({"segment": F.sum("_s").over(w), "_closed": F.sum("_e").over(w) - F.col("_e"), "_all": F.sum("_e").over(W.partitionBy("key"))})
    return rows.where((F.col("segment") > F.col("_closed")) & (F.col("segment") <= F.col("_all"))).drop("_s", "_e", "_closed", "_all")


def recognised(spoken: DataFrame, column: str, model: Callable[[list], list]) -> DataFrame:
    """X19. A model's ``text`` for each segment, asked once a segment; segments without a result go."""
    return corpus.through_model(spoken, column, model, "text", "string").where("coalesce(text, '') <> ''")


def word_times(words: DataFrame, spoken: DataFrame) -> DataFrame:
    """X13. When each word is due: words (key, position, units) over the integral of the rate, (key, t, spoken), as from W18.

    A word is due when the same share has been spoken as of the units before it, in a
    straight line between two measurements. Units are syllables or characters. Where the
    integral stands still, the word comes at the end of the pause. A key without
    measurements, or whose integral is 0, gives null times. One shuffle by key of the union of both; no pairs.
    """
    key, order = W.partitionBy("key"), W.partitionBy("key").orderBy("position")
    need = F.coalesce(F.sum("units").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) / F.sum("units").over(key)
    asked = words.select("key", "position", need.alias("x"), F.lit(None).cast("double").alias("_t"), F.lit(1).alias("_q"))
    share = F.col("spoken") / F.nullif(F.max("spoken").over(key), F.lit(0.0))
    known = spoken.select("key", F.lit(None).cast("long").alias("position"), share.alias("x"), F.col("t").cast("double").alias("_t"), F.lit(0).alias("_q")).where("x is not null")
    line = W.partitionBy("key").orderBy("x", "_q", "_t", "position")
    before, after = line.rowsBetween(W.unboundedPreceding, 0), line.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("_q") == 0, F.struct("x", "_t"))
    rows = asked.unionByName(known).withColumns({"_a": F.last(at, True).over(before), "_b": F.first(at, True).over(after)})
    due = F.when(F.col("_b").isNull() | (F.col("_b.x") == F.col("_a.x")), F.col("_a._t")).otherwise(F.col("_a._t") + (F.col("x") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x")) * (F.col("_b._t") - F.col("_a._t")))
    return rows.where("_q = 1").select("key", "position", F.coalesce(due, F.col("_b._t")).alias("t"))
