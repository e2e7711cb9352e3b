"""Queries on events as metrics and signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import signals as G
from skein.plans.registry import query, table


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def by_user():
    return W.partitionBy("user_id").orderBy("ts", "event_id")


WIN = "(PARTITION BY user_id ORDER BY ts, event_id"
US = "epoch_us(ts)"


@query(f"SELECT event_id, round(avg(value) OVER {WIN} ROWS 4 PRECEDING), 6) AS mean FROM events")
def w1_moving_average(spark, d):
    return events(spark, d).select("event_id", F.round(G.moving_average("value", ["user_id"], ["ts", "event_id"]), 6).alias("mean"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, least(value, 60) AS s FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, least(r.s * 0.7 + o.value * (1 - 0.7::DOUBLE), 60) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, event_id, round(s, 6) AS smoothed FROM r""")
def w2_exponential_smoothing(spark, d):
    return G.smoothed(table(spark, d, "events"), "user_id", "event_id", "value", 0.7, 60.0).withColumn("smoothed", F.round("smoothed", 6))


@query("WITH o AS (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS start, strlen(text) AS n FROM documents) SELECT doc_id, start::BIGINT AS start, (start // 4096)::BIGINT AS first_frame, ((start + n - 1) // 4096)::BIGINT AS last_frame FROM o")
def w16_rebuffering(spark, d):
    """Documents as a byte stream, cut into frames of 4096; offsets in two passes, by ranges of ids."""
    rows = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return G.framed(rows, "doc_id", "n").select("doc_id", "start", "first_frame", "last_frame")


@query(f"WITH x AS (SELECT user_id, event_id, ts, ({US} - lag({US}) OVER {WIN})) / 1e6 * lag(value) OVER {WIN}) AS part FROM events) SELECT event_id, round(coalesce(sum(part) OVER {WIN}), 0), 1) AS integral FROM x")
def w18_integral_of_rate(spark, d):
    part, total = G.integral("value", ["user_id"], ["ts", "event_id"])
    return events(spark, d).withColumn("part", part).select("event_id", F.round(total, 1).alias("integral"))


@query(f"""WITH x AS (SELECT event_id, avg(value) OVER {WIN} ROWS 9 PRECEDING) AS mean, first_value(value) OVER {WIN}) AS base FROM events)
SELECT event_id, round((mean - base) / base * 100, 4) AS change, CASE WHEN (mean - base) / base * 100 >= 100 THEN 'critical' WHEN (mean - base) / base * 100 >= 50 THEN 'high' WHEN (mean - base) / base * 100 >= 20 THEN 'raised' ELSE 'ok' END AS alert FROM x WHERE base > 0""")
def w19_change_alerts(spark, d):
    return G.change_alerts(events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("change", 4).alias("change"), "alert")


@query("SELECT user_id, i AS step, greatest(1.0 - i * 0.15, 0.4)::DOUBLE AS value FROM (SELECT DISTINCT user_id FROM events), range(0, 6) t(i)")
def w24_linear_ramp(spark, d):
    return G.ramp(events(spark, d).select("user_id").distinct(), 1.0, 0.15, 0.4, 6)


@query("""SELECT e.event_id AS asked_id, p.value, round(epoch_us(e.ts) / 1e6 - epoch_us(p.ts) / 1e6, 3) AS age FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def j13_as_of(spark, d):
    e = events(spark, d)
    found = G.value_at(e.where("event_type = 'click'").withColumn("asked_id", F.col("event_id")), e.where("event_type = 'purchase'"), "user_id", "ts", "value")
    return found.select("asked_id", "value", F.round(F.unix_micros("ts") / 1e6 - F.unix_micros("known_at") / 1e6, 3).alias("age"))


@query("SELECT c.event_id, median(v.value) AS level, count(v.value) AS n FROM (SELECT * FROM events WHERE event_type = 'signup') c LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND v.ts BETWEEN c.ts - INTERVAL 6 HOUR AND c.ts + INTERVAL 6 HOUR GROUP BY 1")
def j14_interval_join(spark, d):
    """Both sides are cut into buckets of the interval's length, so that the join is on equality."""
    e = events(spark, d)
    c = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("at"))
    v = e.where("event_type = 'view'").select("user_id", "ts", "value")
    near = G.near_in_time(c, v, "user_id", "at", "ts", 6 * 3600)
    return near.groupBy("event_id").agg(F.median("value").alias("level"), F.count("value").alias("n"))


@query("WITH t AS (SELECT * FROM (VALUES ('en', 0.1), ('fr', 0.2), ('de-AT', 0.3)) t(tag, threshold)), l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '-AT' ELSE lang END AS tag FROM documents) SELECT doc_id, coalesce(a.threshold, b.threshold)::DOUBLE AS threshold FROM l LEFT JOIN t a ON l.tag = a.tag LEFT JOIN t b ON split_part(l.tag, '-', 1) = b.tag")
def j16_language_threshold(spark, d):
    known = spark.createDataFrame([("en", 0.1), ("fr", 0.2), ("de-AT", 0.3)], "tag string, threshold double")
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("-AT"))).otherwise(F.col("lang")).alias("tag"))
    return G.threshold_of(rows, known).select("doc_id", "threshold")


KINDS = "CASE event_type WHEN 'click' THEN 'llm' WHEN 'view' THEN 'realtime' WHEN 'purchase' THEN 'tts' WHEN 'signup' THEN 'stt' ELSE 'eou' END"


@query(f"""WITH m AS (SELECT {KINDS} AS type, event_id % 50 AS p, event_id % 7 AS c, event_id % 11 AS o, user_id AS ch, value FROM events)
SELECT sum(p) FILTER (type IN ('llm', 'realtime'))::BIGINT AS llm_prompt_tokens, sum(c) FILTER (type IN ('llm', 'realtime'))::BIGINT AS llm_prompt_cached_tokens, sum(o) FILTER (type IN ('llm', 'realtime'))::BIGINT AS llm_completion_tokens, sum(p) FILTER (type = 'realtime')::BIGINT AS llm_input_audio_tokens, sum(o) FILTER (type = 'realtime')::BIGINT AS llm_output_audio_tokens, sum(ch) FILTER (type = 'tts')::BIGINT AS tts_characters_count, round(sum(value) FILTER (type = 'tts'), 4) AS tts_audio_duration, round(sum(value) FILTER (type = 'stt'), 4) AS stt_audio_duration FROM m""")
def a4_usage(spark, d):
    """Event types stand in for metric types."""
    kind = F.when(F.col("event_type") == "click", "llm").when(F.col("event_type") == "view", "realtime").when(F.col("event_type") == "purchase", "tts").when(F.col("event_type") == "signup", "stt").otherwise("eou")
    m = events(spark, d).select(kind.alias("type"), (F.col("event_id") % 50).alias("prompt_tokens"), (F.col("event_id") % 7).alias("cached_tokens"), (F.col("event_id") % 11).alias("completion_tokens"), (F.col("event_id") % 50).alias("input_audio_tokens"), (F.col("event_id") % 11).alias("output_audio_tokens"), F.col("user_id").alias("characters"), F.col("value").alias("audio_seconds"))
    out = G.usage(m)
    return out.withColumns({c: F.round(c, 4) for c in ("tts_audio_duration", "stt_audio_duration")})


@query("SELECT event_type, round(avg(value) FILTER (user_id % 10 <> 0), 6) AS mean, median(value) FILTER (user_id % 10 <> 0) AS median, min(value) FILTER (user_id % 10 <> 0) AS low, max(value) FILTER (user_id % 10 <> 0) AS high, round(stddev_samp(value) FILTER (user_id % 10 <> 0), 6) AS deviation, round(avg((user_id % 10 <> 0)::INT), 6) AS success FROM events GROUP BY 1")
def a5_latency_statistics(spark, d):
    out = G.latency(events(spark, d), "event_type", "value", F.col("user_id") % 10 != 0)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "success")})


@query("WITH x AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT user_id, v[least((len(v) * 0.95)::DOUBLE // 1 + 1, len(v))::BIGINT] AS p95 FROM x".replace("(len(v) * 0.95)::DOUBLE // 1", "floor(len(v) * 0.95)"))
def a6_index_percentile(spark, d):
    return G.index_percentile(events(spark, d), "user_id", "value", 0.95, "p95")


@query("SELECT user_id, coalesce(avg(value) FILTER (event_type = 'click'), 0) AS confidence FROM events GROUP BY 1".replace("coalesce(avg(value) FILTER (event_type = 'click'), 0)", "round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 6)"))
def a16_mean_confidence(spark, d):
    return G.mean_confidence(events(spark, d), "user_id", "value", F.col("event_type") == "click").withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT user_id, round((min({US}) FILTER (event_type = 'view') - min({US})) / 1e6, 3) AS ttft, round((max({US}) - min({US})) / 1e6, 3) AS duration, round(count(*) FILTER (event_type = 'view') / ((max({US}) - min({US})) / 1e6), 9) AS rate FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0 AND max(ts) > min(ts)")
def a17_request_metrics(spark, d):
    """A user's events stand in for a request, views for its tokens."""
    out = G.request_metrics(events(spark, d), "user_id", "ts", F.col("event_type") == "view")
    return out.select("user_id", F.round("ttft", 3).alias("ttft"), F.round("duration", 3).alias("duration"), F.round("rate", 9).alias("rate"))


@query(f"WITH x AS (SELECT user_id, value, (row_number() OVER {WIN}) - 1) // 4 AS g FROM events) SELECT user_id, g::BIGINT AS batch, round(sum(value), 6) AS total FROM x GROUP BY 1, 2 HAVING count(*) = 4")
def a18_flushed_batches(spark, d):
    """Batches of ceil(1 / 0.25) inferences; what is left over isn't flushed."""
    return G.flushed(events(spark, d), "user_id", ["ts", "event_id"], "value", 4).withColumn("total", F.round("total", 6))


@query("WITH r AS (SELECT vec_id, label, sqrt(list_avg(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS rms FROM embeddings) SELECT label, round(median(rms), 8) AS rms FROM r GROUP BY 1")
def a20_median_rms(spark, d):
    from skein.functions import vectors as V

    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select("label", F.sqrt(V.dot(e, e) / F.size(e)).alias("rms"))
    return G.medians(rows, "label", "rms", "rms").withColumn("rms", F.round("rms", 8))


@query("SELECT user_id, event_type, CASE WHEN bool_or(value > 45) THEN 'unhealthy' WHEN bool_or(value > 30) THEN 'degraded' ELSE 'healthy' END AS health FROM events GROUP BY 1, 2")
def a21_health(spark, d):
    """A user's events of one type stand in for the checks of a component."""
    return G.health(events(spark, d), ["user_id", "event_type"], F.col("value") > 45, F.col("value") > 30)


@query("SELECT event_type, " + ", ".join(f"sum((value <= {b})::INT)::BIGINT AS le_{i}" for i, b in enumerate((0.1, 0.5, 1, 2.5, 5, 10))) + ", count(*) AS n, max(value) AS gauge FROM events GROUP BY 1")
def a22_histogram(spark, d):
    return G.histogram(events(spark, d), "event_type", "value", (0.1, 0.5, 1, 2.5, 5, 10))


@query("SELECT k * 1000 AS documents, round(avg_chunks * k * 1000, 3) AS vectors FROM (SELECT sum(ceil(n_chars / 512.0)) / count(*) AS avg_chunks FROM documents), (SELECT unnest([3, 4, 5]) AS k)")
def a23_capacity(spark, d):
    rows = table(spark, d, "documents").select(F.ceil(F.col("n_chars") / 512.0).alias("n"))
    return G.capacity(rows, "n", [3000, 4000, 5000]).withColumn("vectors", F.round("vectors", 3))


@query("SELECT user_id, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def a24_duration(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("seconds"))


SESSION = """WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS t, epoch_us(ts) + CASE WHEN event_type = 'click' THEN 3600000000 ELSE 36000000000 END AS until FROM events),
y AS (SELECT *, t > max(until) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh FROM x),
z AS (SELECT *, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM y)
SELECT user_id, count(*) AS n, (max(until) - min(t))::BIGINT AS micros FROM z GROUP BY user_id, s"""


@query(SESSION)
def x3_endpointing(spark, d):
    """An hour after a click, ten after anything else."""
    gap = F.when(F.col("event_type") == "click", "1 hour").otherwise("10 hours")
    out = G.sessions(events(spark, d), gap)
    return out.select("user_id", "n", (F.unix_micros("end") - F.unix_micros("start")).alias("micros"))


@query("""WITH c AS (SELECT conv_id, turn, turn * 2000000 AS t, turn * 2000000 + CASE WHEN regexp_matches(text, '[.!?]$') AND length(text) < 200 THEN 200000 ELSE 5000000 END AS until FROM conversations),
y AS (SELECT *, t > max(until) OVER (PARTITION BY conv_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh FROM c), z AS (SELECT *, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY conv_id ORDER BY t) AS s FROM y)
SELECT conv_id, min(turn) AS first_turn, count(*) AS n FROM z GROUP BY conv_id, s""")
def x4_punctuation_delay(spark, d):
    """A turn every two seconds; a short finished sentence waits 0.2 s, anything else 5 s."""
    done = F.col("text").rlike("[.!?]$") & (F.length("text") < 200)
    rows = table(spark, d, "conversations").withColumn("ts", F.timestamp_micros(F.col("turn") * 2_000_000))
    w = rows.groupBy("conv_id", F.session_window("ts", F.when(done, "200 milliseconds").otherwise("5 seconds")).alias("w")).agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"))
    return w.select("conv_id", "first_turn", "n")


@query(f"WITH x AS (SELECT *, sum((event_type = 'signup')::INT) OVER {WIN}) AS run FROM events) SELECT user_id, run::BIGINT AS run, count(*) AS n FROM x GROUP BY 1, 2")
def x5_utterances(spark, d):
    return G.utterances(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, date_trunc('hour', ts)::VARCHAR AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def x7_rate_limit(spark, d):
    """One an hour here, as no user has ten a minute."""
    return G.over_limit(events(spark, d), 1, width="1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"SELECT event_id FROM events QUALIFY coalesce(event_type <> lag(event_type) OVER {WIN}), true)")
def x14_repeats_suppressed(spark, d):
    return events(spark, d).withColumn("_b", F.lag("event_type").over(by_user())).where("_b is null or event_type <> _b").select("event_id")


@query(f"SELECT event_id, avg(value) OVER {WIN} ROWS 4 PRECEDING) / 50 > 0.7 AS full FROM events".replace("AS full", "AS at_limit"))
def x18_load(spark, d):
    return events(spark, d).select("event_id", G.at_limit("value", 50, ["user_id"], ["ts", "event_id"]).alias("at_limit"))


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15.0 AS start FROM conversations".replace("/ 15.0 AS start", "/ 15.0 AS start_s").replace("SELECT conv_id, turn, coalesce", "SELECT conv_id, turn, round(coalesce").replace("/ 15.0 AS", "/ 15.0, 6) AS"))
def x20_sentence_starts(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.round(G.starts(F.length("text"), "conv_id", "turn") / 15.0, 6).alias("start_s"))


def signal(spark, d):
    """Events as a signal: a sample a tenth of a second, its level from the value."""
    return events(spark, d).select(F.col("user_id").alias("key"), (F.row_number().over(by_user()) / 10.0).alias("t"), (F.col("value") / 50).alias("p"), F.lit(0.1).alias("dt"), F.col("event_type").alias("speaker"), F.col("value").alias("level"))


SIGNAL = f"SELECT user_id AS key, row_number() OVER {WIN}) AS i, value / 50 AS p, event_type AS speaker, value AS level FROM events"


@query(f"""WITH RECURSIVE o AS ({SIGNAL}),
r AS (SELECT DISTINCT key, 0::BIGINT AS i, false AS active, 0::DOUBLE AS up, 0::DOUBLE AS down, false AS flip FROM o
UNION ALL SELECT key, i, active <> flip, up, down, flip FROM (SELECT key, i, active, up, down, CASE WHEN active THEN p < 0.3 AND down >= 0.3 - 1e-9 ELSE p >= 0.3 AND up >= 0.1 - 1e-9 END AS flip
  FROM (SELECT o.key, o.i, o.p, r.active, CASE WHEN o.p >= 0.3 THEN r.up + 0.1::DOUBLE ELSE 0 END AS up, CASE WHEN o.p >= 0.3 THEN 0 ELSE r.down + 0.1::DOUBLE END AS down FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)))
SELECT key, i / 10.0 AS t, CASE WHEN active THEN 'start' ELSE 'end' END AS event, round(CASE WHEN active THEN up ELSE down END, 6) AS duration FROM r WHERE flip""")
def x2_activity(spark, d):
    return G.activity(signal(spark, d), on=0.3, least_on=0.1, least_off=0.3).withColumn("duration", F.round("duration", 6))


@query(f"""WITH RECURSIVE o AS ({SIGNAL}), r AS (SELECT key, i, i AS last, p FROM o WHERE i = 1
UNION ALL SELECT o.key, o.i, CASE WHEN o.i - r.last >= 3 THEN o.i ELSE r.last END, o.p FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
SELECT key, i / 10.0 AS t, p FROM r WHERE i = last""")
def x8_throttle(spark, d):
    return G.throttled(signal(spark, d).select("key", "t", "p"), least=0.3)


@query(f"""WITH RECURSIVE o AS ({SIGNAL}), r AS (SELECT key, i, speaker AS who, level AS level FROM o WHERE i = 1
UNION ALL SELECT o.key, o.i, CASE WHEN o.speaker <> r.who AND o.level > r.level * 1.2::DOUBLE THEN o.speaker ELSE r.who END,
  CASE WHEN o.speaker = r.who THEN greatest(o.level, r.level * 0.8::DOUBLE) WHEN o.level > r.level * 1.2::DOUBLE THEN o.level ELSE r.level * 0.8::DOUBLE END FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
SELECT key, i / 10.0 AS t, who AS primary FROM r""".replace("AS primary", 'AS "primary"'))
def w20_primary_speaker(spark, d):
    return G.primary_speaker(signal(spark, d).select("key", "t", "speaker", "level"))
