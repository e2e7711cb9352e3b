"""Queries on stream and speech operators over whole tables, with their SQL.

The stream folds run once by key here; tests hold them to the same rows as streams.
Conversations are cut into pieces of seven characters, as a model's output comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import history as H
from skein.operators import signals as G
from skein.operators import speech as S
from skein.plans.registry import query, table
from skein.plans.signals import signal
from skein.sources import readers, scratch, sinks
from skein.streaming import pacing, pinned, streams

PIECE = 7


def chats(spark, d):
    return table(spark, d, "conversations")


def pieces(rows: DataFrame, text) -> DataFrame:
    """(key, seq, text): a turn's text in pieces, then a null that ends it."""
    # one pass cuts a text, where a substring for each piece would make the text anew and start at its head
    cut = F.concat(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), F.array(F.lit(None).cast("string")))
    return rows.select(F.col("conv_id").alias("key"), "turn", F.posexplode(cut).alias("_i", "text")).select("key", (F.col("turn") * 1_000_000 + F.col("_i")).alias("seq"), "text")


def joined(parts: DataFrame, order: str) -> DataFrame:
    """The texts of each key, one behind the other."""
    texts = F.array_sort(F.collect_list(F.struct(order, "text")))
    whole = F.array_join(F.transform(texts, lambda x: x["text"]), "")
    return parts.groupBy("key").agg(F.md5(whole).alias("digest"), F.length(whole).cast("long").alias("n"))


@query(r"""WITH s AS (SELECT conv_id AS key, turn, string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(57345), 'g'), chr(57345)) AS p FROM conversations),
u AS (SELECT key, turn, unnest(p) AS sentence, generate_subscripts(p, 1) AS i FROM s)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY turn, i) - 1 AS position, sentence FROM u WHERE sentence <> ''""")
def x1_sentence_stream(spark, d):
    return streams.sentence_stream(pieces(chats(spark, d), F.col("text")), least=1)


@query("""WITH g AS (SELECT conv_id AS key, turn // 3 AS g, max(turn) FILTER (turn % 2 = 0) AS final, max(turn) AS last, string_agg(text, ' ' ORDER BY turn) FILTER (turn % 2 = 0) AS said, arg_max(left(text, length(text) // 2), turn) FILTER (turn % 2 = 1) AS heard, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT key, (last * 10 + 9)::BIGINT AS seq, trim(coalesce(said, '') || ' ' || CASE WHEN last > coalesce(final, -1) THEN heard ELSE '' END) AS text FROM g WHERE n = 3""")
def x6_transcripts(spark, d):
    """Each turn is heard by half; even ones are final; every third turn ends an utterance."""
    kind = F.array(F.lit("interim"), F.when(F.col("turn") % 2 == 0, "final"), F.when(F.col("turn") % 3 == 2, "end"))
    rows = chats(spark, d).select(F.col("conv_id").alias("key"), "turn", "text", F.posexplode(kind).alias("_i", "kind")).where("kind is not null")
    text = F.when(F.col("kind") == "interim", F.left("text", F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    seq = F.col("turn") * 10 + F.when(F.col("kind") == "end", 9).otherwise(F.col("_i"))
    return streams.transcripts(rows.select("key", seq.alias("seq"), "kind", text.alias("text")))


@query("SELECT conv_id AS key, md5(string_agg(text, '' ORDER BY turn)) AS digest, length(string_agg(text, '' ORDER BY turn)) AS n FROM conversations GROUP BY 1")
def p16_without_thoughts(spark, d):
    """Thoughts are put into the middle and at the end of every turn; the rest has to come back."""
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.left("text", half), F.lit("<think>so <b>? </think>"), F.substring("text", half + 1, F.length("text")), F.lit("<think>end</think>"))
    return joined(streams.without_thoughts(pieces(chats(spark, d), text)), "seq")


MARKED = ("# A **title** here\n- see [the page](http://x.org/a b) and `code` ", " *or not* _so_")


@query("SELECT conv_id AS key, md5(string_agg(t, '' ORDER BY turn)) AS digest, length(string_agg(t, '' ORDER BY turn)) AS n FROM (SELECT *, 'A title here' || chr(10) || 'see the page and code ' || text || ' or not so' AS t FROM conversations) GROUP BY 1")
def n2_markdown_stream(spark, d):
    """Marks are put around every turn; the text without them has to come back."""
    return joined(streams.markdown_stream(pieces(chats(spark, d), F.concat(F.lit(MARKED[0]), "text", F.lit(MARKED[1])))), "position")


@query("""WITH x AS (SELECT user_id AS path, ts, ts > max(ts) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 10 HOUR AS fresh FROM events),
y AS (SELECT path, ts, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY path ORDER BY ts) AS s FROM x) SELECT path, count(*) AS changes, epoch_us(max(ts)) AS last FROM y GROUP BY path, s""")
def x9_settled_files(spark, d):
    """Users stand in for files; ten hours of quiet."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.settled_files(rows, "10 hours").select("path", "changes", F.unix_micros("last").alias("last"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 1 OR doc_id % 3 = 0 THEN upper(lang) ELSE lang END) AS digest FROM documents")
def x10_upserted_snapshot(spark, d):
    """Two batches into one snapshot table: even ids, then the odd ones, and those divisible by three anew."""
    path = scratch.folder(spark, "x10")
    rows = table(spark, d, "documents").select("doc_id", "lang")
    sink = streams.upsert_into(path, "doc_id")
    sink(rows.where("doc_id % 2 = 0"), 0)
    sink(rows.where("doc_id % 2 = 1 or doc_id % 3 = 0").withColumn("lang", F.upper("lang")), 1)
    return readers.snapshot(spark, path).select("doc_id", F.md5("lang").alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def s9_snapshot(spark, d):
    """A first version with half of the rows, then the whole table; the newest is read."""
    path = scratch.folder(spark, "s9")
    rows = table(spark, d, "documents").select("doc_id", "text")
    sinks.publish(rows.where("doc_id % 2 = 0"), path)
    sinks.publish(rows, path)
    return readers.snapshot(spark, path).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 0")
def s11_report(spark, d):
    path = scratch.folder(spark, "s11")
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1 or doc_id % 3 = 0"):
        sinks.append_report(rows.where(part), path)
    return spark.read.schema("doc_id long, lang string, n_chars long").json(path)


@query(r"SELECT md5(source || '#' || CASE WHEN doc_id < 1000000 THEN lpad(doc_id::VARCHAR, 6, '0') ELSE doc_id::VARCHAR END || ': ' || replace(replace(replace(text, '\', '\\'), chr(13), '\r'), chr(10), '\n')) AS digest FROM documents")
def s3_text_files(spark, d):
    """The export's files, read whole, line by line."""
    path = scratch.folder(spark, "s3")
    sinks.write_export(table(spark, d, "documents"), path)
    lines = readers.text_files(spark, path).select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.select(F.md5("line").alias("digest")).where("line <> ''")


@query("SELECT lang || '.txt' AS file_name, lang AS stem, sum(strlen(lang) + 1)::BIGINT AS size FROM documents GROUP BY lang HAVING lang IS NOT NULL".replace("lang || '.txt' AS file_name, lang AS stem", "count(*) AS n, lang").replace("count(*) AS n, lang, sum(strlen(lang) + 1)::BIGINT AS size", "lang, sum(strlen(doc_id::VARCHAR) + 1)::BIGINT AS size"))
def s6_listing(spark, d):
    """Ids written as text files by language; the listing's sizes add up to the bytes written."""
    path = scratch.folder(spark, "s6")
    table(spark, d, "documents").where("lang is not null").select("lang", F.col("doc_id").cast("string").alias("value")).repartition("lang", F.pmod(F.xxhash64("value"), F.lit(64))).write.partitionBy("lang").text(path)
    return readers.listing(spark, path, "*.txt").groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).agg(F.sum("size").alias("size"))


def said(texts: list) -> list:
    """A stand-in for speech recognition: it hears nothing in short segments."""
    return [t.upper() if len(t) > 20 else "" for t in texts]


@query()
def x19_recognised_segments(spark, d):
    """Activity as in X2; the event types of a segment stand in for its sound."""
    rows = signal(spark, d)
    found = S.segments(rows, G.activity(rows, on=0.3, least_on=0.1, least_off=0.3))
    sounds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "speaker"))), lambda x: x["speaker"]), " ")
    return S.recognised(found.groupBy("key", "segment").agg(sounds.alias("sound")), "sound", said).select("key", "segment", "text")


@query()
def w17_speaking_rates(spark, d):
    """Vectors of a label as sound of 640 samples a second."""
    rows = table(spark, d, "embeddings").select(F.crc32(F.col("label").cast("string").cast("binary")).alias("key"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))
    return S.speaking_rates(rows, 640)


@query("""WITH w AS (SELECT conv_id AS key, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS w FROM conversations)),
n AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY turn, i) - 1 AS position, length(word) // 3 + 1 AS units FROM w),
a AS (SELECT key, position, coalesce(sum(units) OVER (PARTITION BY key ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(units) OVER (PARTITION BY key) AS x FROM n),
k AS (SELECT conv_id AS key, (turn + 1)::DOUBLE AS t, sum(turn % 3) OVER (PARTITION BY conv_id ORDER BY turn)::DOUBLE AS s FROM conversations UNION ALL SELECT DISTINCT conv_id, 0.0, 0.0 FROM conversations),
z AS (SELECT key, t, s / nullif(max(s) OVER (PARTITION BY key), 0) AS x FROM k), lo AS (SELECT key, x, max(t) AS t FROM z WHERE x IS NOT NULL GROUP BY 1, 2), hi AS (SELECT key, x, min(t) AS t FROM z WHERE x IS NOT NULL GROUP BY 1, 2),
b AS (SELECT a.*, lo.x AS x0, lo.t AS t0 FROM a ASOF LEFT JOIN lo ON a.key = lo.key AND a.x >= lo.x), c AS (SELECT b.*, hi.x AS x1, hi.t AS t1 FROM b ASOF LEFT JOIN hi ON b.key = hi.key AND b.x < hi.x)
SELECT key, position, round(CASE WHEN x1 IS NULL THEN t0 ELSE t0 + (x - x0) / (x1 - x0) * (t1 - t0) END, 6) AS t FROM c""")
def x13_word_times(spark, d):
    """A measurement a turn, a second apart; nothing is spoken in every third turn."""
    from pyspark.sql import Window as W

    words = chats(spark, d).select(F.col("conv_id").alias("key"), "turn", F.posexplode(F.split("text", "[ \n]")).alias("_i", "word"))
    words = words.withColumn("position", (F.row_number().over(W.partitionBy("key").orderBy("turn", "_i")) - 1).cast("long")).withColumn("units", F.floor(F.length("word") / 3) + 1)
    w = W.partitionBy("conv_id").orderBy("turn")
    spoken = chats(spark, d).select(F.col("conv_id").alias("key"), (F.col("turn") + 1).cast("double").alias("t"), F.sum(F.col("turn") % 3).over(w).cast("double").alias("spoken"))
    start = chats(spark, d).select(F.col("conv_id").alias("key"), F.lit(0.0).alias("t"), F.lit(0.0).alias("spoken")).distinct()
    return S.word_times(words, spoken.unionByName(start)).withColumn("t", F.round("t", 6))


@query("SELECT event_id AS message_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS text FROM events WHERE user_id % 2 = 0 OR event_id % 11 = 0")
def c8_sealed_history(spark, d):
    """Messages sealed under their day's key, opened by J11's lookup after the keys were wrapped anew.

    Half of the users have no key at all and their messages aren't kept, and every
    eleventh message has its role changed, so that it doesn't open.
    """
    e = table(spark, d, "events").select(F.col("event_id").alias("message_id"), "user_id", F.col("event_type").alias("role"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("props").alias("text"))
    users = e.select("user_id", H.day_of(F.col("ts")).alias("day")).distinct()
    dek = F.unhex(F.md5(F.concat_ws("|", "user_id", "day")))
    kek = [F.unhex(F.md5(F.lit(f"master {i}"))) for i in (1, 2)]
    email = F.concat(F.lit("u"), "user_id", F.lit("@x.org"))
    wrapped = users.withColumn("email", email).withColumn("_s", H.sealed(dek, kek[0], H.bound_to_key(F.col("user_id"), F.when(F.col("user_id") % 4 == 0, "unknown").otherwise(F.col("email")))))
    wrapped = H.rewrapped(wrapped.select("user_id", "day", "email", "_s.cipher", "_s.nonce", F.lit(1).alias("version")), kek[0], kek[1], 2)
    keys = scratch.written(wrapped.select("user_id", "day", H.opened(F.col("cipher"), F.col("nonce"), kek[1], H.bound_to_key(F.col("user_id"), F.col("email"))).alias("key")), "c8-keys")
    bound = lambda role: H.bound_to_message(F.col("user_id"), F.lit("agent"), role, F.col("ts"))
    day_key = F.unhex(F.md5(F.concat_ws("|", "user_id", H.day_of(F.col("ts")))))
    sealed = e.where("user_id % 2 = 0 or message_id % 11 = 0").withColumn("_s", H.sealed(F.col("text"), day_key, bound(F.col("role"))))
    sealed = scratch.written(sealed.select("message_id", "user_id", "ts", F.when(F.col("message_id") % 11 == 0, "system").otherwise(F.col("role")).alias("role"), "_s.cipher", "_s.nonce"), "c8-messages")
    return H.with_keys(sealed, keys).select("message_id", H.opened(F.col("cipher"), F.col("nonce"), F.col("key"), bound(F.col("role"))).cast("string").alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS version FROM documents")
def x11_pinned_snapshots(spark, d):
    """A version is published between two batches, and the first batch runs again after that: it reads what it read before."""
    path, pins, out = (scratch.folder(spark, f"x11-{x}") for x in ("snapshots", "pins", "out"))
    rows = table(spark, d, "documents").select("doc_id")
    sink = pinned.with_newest(path, pins, lambda batch, known, n: batch.crossJoin(F.broadcast(known)).write.mode("overwrite").parquet(f"{out}/batch={n}"))  # one row
    for n, version in enumerate(("first", "second")):
        sinks.publish(spark.createDataFrame([(version,)], "version string"), path)
        sink(rows.where(f"doc_id % 2 = {n}"), n)
    sink(rows.where("doc_id % 2 = 0"), 0)
    return spark.read.parquet(out).select("doc_id", "version")


@query()
def x12_paced_text(spark, d):
    """A turn is a sentence a tenth of a second after the one before; every text brings sound by its length two seconds on."""
    c = chats(spark, d).select(F.concat(F.lit("c"), "conv_id").alias("key"), (F.col("turn") * 0.1).alias("t"), "text")
    said = c.select("key", "t", "text", F.lit(None).cast("double").alias("seconds"))
    sound = c.select("key", (F.col("t") + 2).alias("t"), F.lit(None).cast("string").alias("text"), (F.length("text") / 15.0).alias("seconds"))
    return pacing.paced(said.unionByName(sound))


@query("SELECT 'texts' AS sink, lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL UNION ALL SELECT 'long', lang, count(*), sum(length(text))::BIGINT FROM documents WHERE length(text) > 1000 GROUP BY ALL")
def x15_fan_out(spark, d):
    """A stream of all documents in several micro-batches to two sinks; a batch that ran again would replace its own files."""
    source, out, checkpoint = (scratch.folder(spark, f"x15-{x}") for x in ("in", "out", "checkpoint"))
    table(spark, d, "documents").select("doc_id", "lang", "text").repartition(4).write.parquet(source)

    def sink(name: str, condition: str):
        return lambda batch, n: batch.where(condition).select("lang", F.length("text").alias("chars")).write.mode("overwrite").parquet(f"{out}/sink={name}/batch={n}")

    stream = spark.readStream.schema("doc_id long, lang string, text string").option("maxFilesPerTrigger", 2).parquet(source)
    streams.to_sinks(stream, [sink("texts", "true"), sink("long", "length(text) > 1000")], checkpoint).awaitTermination()
    rows = spark.read.schema("lang string, chars int, sink string, batch int").parquet(out)
    return rows.groupBy("sink", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))

