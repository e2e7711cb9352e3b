"""Ordered samples by key: smoothing, activity, segments, rates, roll-ups.

What a frame or a session can express is a window. Recursions (smoothing, activity
with hysteresis, the primary speaker) are folds by key in Arrow or pandas groups; a
key's samples are one task's, so that a key must be a stream of bounded length, such
as a user's day.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY, MARGIN = 10_000, 0.0005  #: of approximate quantiles: their error is a part in ACCURACY


def moving_average(value: str, by: list[str], order: list[str], n: int = 5) -> Column:
    """W1. The mean of the last n samples."""
    return F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0))


def smoothed(samples: DataFrame, key: str, order: str, value: str, alpha: float, cap: float | None = None) -> DataFrame:
    """W2. Exponential smoothing: the first sample seeds it, each later one moves it by 1 - alpha, up to a cap.

    A fold over sorted rows that holds one value at a time. A null sample stays null, and
    the next one seeds it again.
    """
    rows = samples.select(key, order, F.col(value).cast("double").alias("smoothed"))

    def run(batches):
        at, last = None, None
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if v is not None and last is not None and k == at:
                    v = last * alpha + v * (1 - alpha)
                last = v if v is None or cap is None else min(v, float(cap))
                at = k
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=[key, order, "smoothed"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, rows.schema)


def activity(samples: DataFrame, key: str = "key", on: float = 0.5, least_on: float = 0.05, least_off: float = 0.55) -> DataFrame:
    """X2. Starts and ends of activity in samples (key, t, p, dt): on after ``least_on`` seconds above, off after ``least_off`` below."""

    def run(rows):
        import pandas as pd

        out, active, up, down = [], False, 0.0, 0.0
        for r in rows.sort_values("t", kind="stable").itertuples(index=False):
            if r.p >= on:
                up, down = up + r.dt, 0.0
                change = not active and up >= least_on - 1e-9
            else:
                up, down = 0.0, down + r.dt
                change = active and down >= least_off - 1e-9
            if change:
                active = not active
                out.append((rows[key].iloc[0], r.t, "start" if active else "end", up if active else down))
        return pd.DataFrame(out, columns=[key, "t", "event", "duration"])

    return samples.groupBy(key).applyInPandas(run, f"{key} long, t double, event string, duration double")


def sessions(events: DataFrame, gap: Column, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """X3, X4. Turns that end when nothing comes for the event's own delay (session windows with a dynamic gap)."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def utterances(events: DataFrame, key: str, order: list[str], opens: Column) -> DataFrame:
    """X5. Numbers the runs that an opening event starts; what comes before the first is run 0."""
    w = W.partitionBy(key).orderBy(*order)
    return events.withColumn("run", F.sum(opens.cast("int")).over(w))


def over_limit(events: DataFrame, most: int, key: str = "user_id", ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """X7. Fixed windows, aligned to the clock, in which a key had more than ``most`` events."""
    return events.groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key, F.col("w.start").alias("start"), "n")


def throttled(samples: DataFrame, key: str = "key", least: float = 0.1) -> DataFrame:
    """X8. Samples (key, t, ...) at least ``least`` seconds after the last one that was let through."""

    def run(rows):
        rows = rows.sort_values("t", kind="stable")
        keep, last = [], None
        for t in rows["t"]:
            keep.append(last is None or t - last >= least - 1e-9)
            last = t if keep[-1] else last
        return rows[keep]

    return samples.groupBy(key).applyInPandas(run, samples.schema)


def primary_speaker(samples: DataFrame, key: str = "key", decay: float = 0.8, margin: float = 1.2) -> DataFrame:
    """W20. Samples (key, t, speaker, level): who is primary; another takes over when louder than the decayed level by a margin."""

    def run(rows):
        import pandas as pd

        out, who, level = [], None, 0.0
        for r in rows.sort_values("t", kind="stable").itertuples(index=False):
            if r.speaker == who:
                level = max(r.level, level * decay)
            elif who is None or r.level > level * margin:
                who, level = r.speaker, r.level
            else:
                level *= decay
            out.append((rows[key].iloc[0], r.t, who))
        return pd.DataFrame(out, columns=[key, "t", "primary"])

    return samples.groupBy(key).applyInPandas(run, f"{key} long, t double, primary string")


def value_at(asked: DataFrame, known: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """J13. As of: the last known value at or before each asked time, its time, and null before the first.

    One shuffle of both by key and a running last over their union; no pairs are made.
    """
    both = known.select(key, ts, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_q"), F.lit(None).cast("long").alias("asked_id")).unionByName(asked.select(key, ts, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_q"), F.col("asked_id").cast("long")))
    w = W.partitionBy(key).orderBy(ts, "_q").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("value", F.last("_v", ignorenulls=True).over(w)).withColumn("known_at", F.last(F.when(F.col("_v").isNotNull(), F.col(ts)), ignorenulls=True).over(w))
    return found.where("_q = 1").select("asked_id", key, ts, "value", "known_at")


def at_rank(rows: DataFrame, by: str, value: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """Exact values at ranks of each group: ``ranks`` gives by name a share and the 1-based rank, from ``_n`` values.

    Approximate quantiles on both sides of the share, five times further off than their
    error, bound the rank; only values between them are counted by value and summed up
    in order, so that no task holds or sorts a hot group. Null values don't count; a
    group without others has no row.
    """
    v = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("_v"))
    near = {n: (F.percentile_approx("_v", max(p - MARGIN, 0.0), ACCURACY), F.percentile_approx("_v", min(p + MARGIN, 1.0), ACCURACY)) for n, (p, _) in ranks.items()}
    bounds = v.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), *(c.alias(f"_{n}_{i}") for n, pair in near.items() for i, c in enumerate(pair)))
    ends = [F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank"), (F.col("_least") if p <= MARGIN else F.col(f"_{n}_0")).alias("low"), (F.col("_most") if p >= 1 - MARGIN else F.col(f"_{n}_1")).alias("high")) for n, (p, r) in ranks.items()]
    asked = bounds.select(by, F.explode(F.array(*ends)).alias("_r")).select(by, "_r.*")
    # a row for each group and rank, so that it is small beside the values
    placed = v.join(asked, by).where(F.col("_v") <= F.col("high"))
    counted = placed.groupBy(by, "name", "rank", F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(by, "name").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)
    summed = counted.withColumn("_upto", F.sum("_c").over(order))
    found = summed.where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_c")))
    return found.groupBy(by).agg(*(F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in ranks))


def index_percentile(rows: DataFrame, by: str, value: str, p: float, out: str) -> DataFrame:
    """A6. The value at place int(n * p) of the sorted values; neither interpolated nor nearest rank."""
    return at_rank(rows, by, value, {out: (p, F.least(F.floor(F.col("_n") * p) + 1, F.col("_n")))})


def medians(rows: DataFrame, by: str, value: str, out: str = "median") -> DataFrame:
    """A5, A20. Exact medians, the mean of the middle two where they are even in number."""
    found = at_rank(rows, by, value, {"_a": (0.5, F.floor((F.col("_n") + 1) / 2)), "_b": (0.5, F.floor(F.col("_n") / 2) + 1)})
    return found.select(by, ((F.col("_a") + F.col("_b")) / 2).alias(out))


def latency(rows: DataFrame, by: str, value: str, ok: Column) -> DataFrame:
    """A5. Mean, median, least, most, sample deviation and success rate."""
    v = F.when(ok, F.col(value))
    out = rows.groupBy(by).agg(F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("deviation"), F.avg(ok.cast("int")).alias("success"))
    return out.join(medians(rows.select(by, v.alias(value)), by, value), by, "left")


def usage(rows: DataFrame) -> DataFrame:
    """A4. One row of usage counters from metrics (type, prompt_tokens, cached_tokens, completion_tokens, input_audio_tokens, output_audio_tokens, characters, audio_seconds)."""
    of = lambda c, *kinds: F.coalesce(F.sum(F.when(F.col("type").isin(*kinds), F.col(c))), F.lit(0))
    both = ("llm", "realtime")
    return rows.agg(of("prompt_tokens", *both).alias("llm_prompt_tokens"), of("cached_tokens", *both).alias("llm_prompt_cached_tokens"), of("completion_tokens", *both).alias("llm_completion_tokens"), of("input_audio_tokens", "realtime").alias("llm_input_audio_tokens"), of("output_audio_tokens", "realtime").alias("llm_output_audio_tokens"), of("characters", "tts").alias("tts_characters_count"), of("audio_seconds", "tts").alias("tts_audio_duration"), of("audio_seconds", "stt").alias("stt_audio_duration"))


def integral(rate: str, by: list[str], order: list[str], ts: str = "ts") -> tuple[Column, Column]:
    """W18. (part, total): what a rate adds up to since the sample before, and since the first; a rate holds until the next.

    The total is a window over the part as a column, so it is given its name: ``part``.
    """
    w = W.partitionBy(*by).orderBy(*order)
    us = F.unix_micros(ts)
    return (us - F.lag(us).over(w)) / 1e6 * F.lag(rate).over(w), F.coalesce(F.sum("part").over(w), F.lit(0.0))


def alert(change: Column) -> Column:
    """W19. The level of a change in per cent."""
    return F.when(change >= 100, "critical").when(change >= 50, "high").when(change >= 20, "raised").otherwise("ok")


def change_alerts(rows: DataFrame, key: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """W19. The change of the mean of the last n samples against the first sample, in per cent, with its alert; none where that isn't positive."""
    w = W.partitionBy(key).orderBy(*order)
    based = rows.withColumns({"_mean": moving_average(value, [key], order, n), "_base": F.first(value).over(w)}).where("_base > 0")
    change = (F.col("_mean") - F.col("_base")) / F.col("_base") * 100
    return based.withColumn("change", change).withColumn("alert", alert(F.col("change"))).drop("_mean", "_base")


def ramp(keys: DataFrame, start: float, by: float, target: float, steps: int) -> DataFrame:
    """W24. For each row ``steps`` values that go down by a step each, not below the target."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")))
    return keys.withColumn("step", every).withColumn("value", F.greatest(F.lit(start) - F.col("step") * by, F.lit(target)))


def framed(chunks: DataFrame, key: str, size: str, frame: int = 4096, run: int = 4096) -> DataFrame:
    """W16. Chunks (key in order, ``size`` in bytes as a column's name) as one stream cut into frames: start, first and last frame.

    Offsets come from two passes, sums by runs of keys and then inside a run, so that no
    task orders all chunks. A chunk without bytes has its last frame before the first.
    """
    rows = chunks.withColumn("_run", F.floor(F.col(key) / run))
    before = rows.groupBy("_run").agg(F.sum(size).alias("_n")).select("_run", F.coalesce(F.sum("_n").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(size).over(W.partitionBy("_run").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_in", inside).join(before, "_run").withColumn("start", F.col("_base") + F.col("_in"))
    return placed.withColumns({"first_frame": F.floor(F.col("start") / frame), "last_frame": F.floor((F.col("start") + F.col(size) - 1) / frame)}).drop("_run", "_in", "_base")


def near_in_time(asked: DataFrame, known: DataFrame, key: str, at: str, ts: str, seconds: int) -> DataFrame:
    """J14. Asked rows with the known ones of their key at most so many seconds away, by buckets of that length and equality.

    An asked row stands in three buckets; in each of these it has a row with nulls if nothing is near.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c) / seconds)
    a = asked.withColumn("_b", F.explode(F.array(*(bucket(F.col(at)) + i for i in (-1, 0, 1)))))
    k = known.withColumn("_b", bucket(F.col(ts)))
    close = F.abs(F.unix_micros(k[ts]) - F.unix_micros(a[at])) <= seconds * 1_000_000
    return a.join(k, (a[key] == k[key]) & (a["_b"] == k["_b"]) & close, "left").drop(k[key], a["_b"], k["_b"])


def mean_confidence(rows: DataFrame, by: str, value: str, counts: Column) -> DataFrame:
    """A16. The mean of those values that count, 0 if none does."""
    return rows.groupBy(by).agg(F.coalesce(F.avg(F.when(counts, F.col(value))), F.lit(0.0)).alias("confidence"))


def request_metrics(rows: DataFrame, by: str, ts: str, token: Column) -> DataFrame:
    """A17. Seconds to the first token, seconds in all and tokens a second of each request; requests without tokens or time are left out."""
    us = F.unix_micros(ts)
    out = rows.groupBy(by).agg(F.min(us).alias("_a"), F.max(us).alias("_b"), F.min(F.when(token, us)).alias("_t"), F.count_if(token).alias("_n")).where("_n > 0 and _b > _a")
    seconds = (F.col("_b") - F.col("_a")) / 1e6
    return out.select(by, ((F.col("_t") - F.col("_a")) / 1e6).alias("ttft"), seconds.alias("duration"), (F.col("_n") / seconds).alias("rate"))


def flushed(rows: DataFrame, by: str, order: list[str], value: str, n: int) -> DataFrame:
    """A18. Sums of full batches of n samples; what is left over isn't flushed."""
    batch = F.floor((F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1) / n)
    sums = rows.withColumn("batch", batch).groupBy(by, "batch").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("_n"))
    return sums.where(F.col("_n") == n).drop("_n")


def health(rows: DataFrame, by: list[str], fails: Column, warns: Column) -> DataFrame:
    """A21. Unhealthy if any check fails, degraded if any warns."""
    return rows.groupBy(*by).agg(F.when(F.bool_or(fails), "unhealthy").when(F.bool_or(warns), "degraded").otherwise("healthy").alias("health"))


def histogram(rows: DataFrame, by: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """A22. Cumulative counts up to each bound, all values' count and the largest as a gauge."""
    return rows.groupBy(by).agg(*(F.sum((F.col(value) <= b).cast("int")).alias(f"le_{i}") for i, b in enumerate(bounds)), F.count(F.lit(1)).alias("n"), F.max(value).alias("gauge"))


def capacity(chunks: DataFrame, key: str, documents: list[int]) -> DataFrame:
    """A23. Vectors to expect for numbers of documents, from a table of documents with their chunks as ``key``."""
    mean = chunks.agg((F.sum(key) / F.count(F.lit(1))).alias("_m"))
    return mean.withColumn("documents", F.explode(F.array(*(F.lit(n) for n in documents)))).select("documents", (F.col("_m") * F.col("documents")).alias("vectors"))


def starts(seconds: Column, by: str, order: str) -> Column:
    """X20. When each sentence starts: the seconds of those before it."""
    return F.coalesce(F.sum(seconds).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def at_limit(load: str, capacity: float, by: list[str], order: list[str], threshold: float = 0.7, n: int = 5) -> Column:
    """X18. Whether the mean load of the last n samples is over that share of the capacity, so that no more work is taken."""
    return moving_average(load, by, order, n) / capacity > threshold


def threshold_of(rows: DataFrame, known: DataFrame, tag: str = "tag") -> DataFrame:
    """J16. The ``threshold`` known for a language tag, else for the part before its hyphen; a small table is looked up twice."""
    base = F.split_part(F.col(tag), F.lit("-"), F.lit(1))
    exact, general = known.select(F.col("tag").alias(tag), F.col("threshold").alias("_e")), known.select(F.col("tag").alias("_base"), F.col("threshold").alias("_g"))
    return rows.withColumn("_base", base).join(exact, tag, "left").join(general, "_base", "left").withColumn("threshold", F.coalesce("_e", "_g")).drop("_base", "_e", "_g")
