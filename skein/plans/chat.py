"""Queries on conversations, with their SQL. Turns stand in for time, which the table lacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import chat as C
from skein.operators import history as H
from skein.plans.registry import query, table

S = X.SPACE


def chats(spark, d):
    return table(spark, d, "conversations")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def w3_last_n(spark, d):
    return C.last_n(chats(spark, d), 4).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def w11_history_limit(spark, d):
    return C.last_n(chats(spark, d), 6).select("conv_id", "turn", "role")


@query("""WITH x AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, min(turn) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS s FROM conversations),
t AS (SELECT *, sum((role <> 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM x WHERE n <= 3 OR r <= 3)
SELECT conv_id, turn AS position, turn FROM t WHERE n <= 3 OR seen > 0 UNION ALL SELECT conv_id, -1, turn FROM x WHERE n > 3 AND turn = s""")
def w4_truncate(spark, d):
    """Assistant turns stand in for tool items."""
    return C.truncated(chats(spark, d), 3, ("assistant",)).select("conv_id", "position", "turn")


@query("""WITH x AS (SELECT *, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS n FROM conversations),
y AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) - 200 AS excess, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS before FROM x)
SELECT conv_id, turn FROM y WHERE NOT (role = 'assistant' AND before < excess)""")
def w5_rolling_budget(spark, d):
    """Assistant turns stand in for retrieved context."""
    return C.rolling_budget(chats(spark, d), 200, F.col("role") == "assistant").select("conv_id", "turn")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM conversations), x AS (SELECT *, (role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS fresh FROM m),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM x)
SELECT conv_id, min(turn) AS turn, role, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM y GROUP BY conv_id, run, role""")
def w9_merge_turns(spark, d):
    """System turns count as the user's, as no turns of one role meet otherwise."""
    rows = chats(spark, d).withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return C.merged_turns(rows).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def w10_last_user_message(spark, d):
    return C.last_of_role(chats(spark, d))


@query("WITH x AS (SELECT conv_id, turn, 2 * (turn // 2) AS created FROM conversations) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY created, turn) AS position FROM x")
def w12_ordered_insert(spark, d):
    rows = chats(spark, d).select("conv_id", "turn", (F.floor(F.col("turn") / 2) * 2).alias("created"))
    return C.placed_by(rows, "created").select("conv_id", "turn", "position")


@query("WITH b AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN text || '!' ELSE text END AS text FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 2)) SELECT conv_id, bool_and(a.text IS NOT DISTINCT FROM b.text) AS same FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) a FULL JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM b) b USING (conv_id, i) GROUP BY 1")
def w14_sequence_equivalence(spark, d):
    a = chats(spark, d)
    b = a.where(~((F.col("conv_id") % 7 == 0) & (F.col("turn") == 2))).withColumn("text", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return C.same_sequence(a, b, "text")


@query("WITH x AS (SELECT conv_id, turn, turn // 2 AS level FROM conversations), y AS (SELECT *, row_number() OVER w AS i, level IS NOT DISTINCT FROM lag(level) OVER w AS same FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn FROM y WHERE NOT (same AND i > 1)")
def w22_without_repeats(spark, d):
    return C.without_repeats(chats(spark, d).withColumn("level", F.floor(F.col("turn") / 2)), "level").select("conv_id", "turn")


@query(f"""WITH x AS (SELECT conv_id, turn, len(regexp_split_to_array(regexp_replace(text, '^{S}+|{S}+$', '', 'g'), '{S}+')) AS n FROM conversations), y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tail, first_value(n) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM x)
SELECT conv_id, turn FROM y WHERE i = 1 OR tail <= 250 - head""")
def w23_word_budget(spark, d):
    return C.within_words(chats(spark, d), 250).select("conv_id", "turn")


@query("WITH x AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '2024-02-05') / 86400000000.0 AS days FROM events), y AS (SELECT user_id, event_id, ts, CASE WHEN days < 1 THEN 'today' WHEN days < 2 THEN 'yesterday' WHEN days < 7 THEN floor(days)::BIGINT || ' days ago' WHEN days < 14 THEN 'more than a week ago' WHEN days < 30 THEN '2 weeks ago' ELSE 'more than a month ago' END AS label FROM x) SELECT user_id, event_id, label FROM y QUALIFY label IS DISTINCT FROM lag(label) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def w8_relative_date_groups(spark, d):
    rows = table(spark, d, "events").withColumn("label", C.relative_day(F.col("ts").cast("timestamp"), F.lit("2024-02-05").cast("timestamp")))
    return C.headed(rows, "user_id", ["ts", "event_id"], "label").where("heading").select("user_id", "event_id", "label")


@query(f"SELECT role, count(*) AS messages, sum(length(text))::BIGINT AS chars, sum(length(text) // 4)::BIGINT AS tokens, sum(CASE WHEN turn % 2 = 1 THEN length(text) // 4 ELSE 0 END)::BIGINT AS retrieved FROM conversations GROUP BY 1")
def a8_chat_statistics(spark, d):
    return C.statistics(chats(spark, d), F.col("turn") % 2 == 1)


@query(r"WITH m AS (SELECT doc_id, unnest(w) AS memory, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents)) SELECT doc_id, memory, i - 1 AS position FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, lower(memory) ORDER BY i) = 1")
def a12_distinct_ignoring_case(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return C.distinct_elements(docs, "doc_id", F.split("text", "[ \n]"), "memory", "position").select("doc_id", "memory", "position")


CALLS = "calls AS (SELECT 'c' || event_id % 400 || '-' || user_id AS call_id, event_id AS call FROM events WHERE event_type = 'click'), outs AS (SELECT 'c' || event_id % 400 || '-' || user_id AS call_id, event_id AS output FROM events WHERE event_type = 'view')"


def calls(spark, d):
    rows = table(spark, d, "events").withColumn("call_id", F.concat(F.lit("c"), F.col("event_id") % 400, F.lit("-"), F.col("user_id")))
    return rows.where("event_type = 'click'").select("call_id", F.col("event_id").alias("call")), rows.where("event_type = 'view'").select("call_id", F.col("event_id").alias("output"))


@query(f"WITH {CALLS} SELECT call_id, call, output FROM calls JOIN outs USING (call_id)")
def j9_tool_pairs(spark, d):
    return C.paired_calls(*calls(spark, d))


@query(f"WITH {CALLS} SELECT call_id FROM calls INTERSECT SELECT call_id FROM outs")
def e2_intersection_of_calls(spark, d):
    a, b = calls(spark, d)
    return a.select("call_id").intersect(b.select("call_id"))


@query("SELECT conv_id, turn, 'old' AS version FROM conversations WHERE turn <= 3 UNION ALL SELECT conv_id, turn, 'new' FROM conversations WHERE turn >= 2 AND turn > 3")
def j10_append_missing(spark, d):
    rows = chats(spark, d).select("conv_id", "turn")
    old, new = (rows.where(f"turn {c}").withColumn("version", F.lit(v)) for c, v in (("<= 3", "old"), (">= 2", "new")))
    return C.appended(old, new, "conv_id", "turn")


@query("""WITH k AS (SELECT DISTINCT user_id, strftime(ts, '%Y%m%d') AS day FROM events WHERE event_type = 'signup'), e AS (SELECT event_id, user_id, unnest([strftime(ts, '%Y%m%d'), strftime(ts - INTERVAL 1 DAY, '%Y%m%d'), strftime(ts + INTERVAL 1 DAY, '%Y%m%d')]) AS day, unnest([0, 1, 2]) AS p FROM events WHERE event_type = 'error')
SELECT event_id, arg_min(k.day, p) AS key_day FROM e LEFT JOIN k USING (user_id, day) GROUP BY 1""".replace("arg_min(k.day, p)", "arg_min(CASE WHEN k.user_id IS NULL THEN NULL ELSE day END, CASE WHEN k.user_id IS NULL THEN NULL ELSE p END)"))
def j11_day_key(spark, d):
    """Days with a signup stand in for days with a key."""
    e = table(spark, d, "events").withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp")))
    day = H.day_of(F.col("ts"))
    keys = e.where("event_type = 'signup'").select("user_id", day.alias("day"), day.alias("key")).distinct()
    return H.with_keys(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), keys).select("event_id", F.col("key").alias("key_day"))


@query("SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 30")
def p9_skip_short(spark, d):
    """Thirty characters here, as no message is under three."""
    return C.long_enough(chats(spark, d), 30).select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE role NOT IN ('system', 'developer') AND text <> ''")
def p10_exclude_instructions(spark, d):
    return C.without_instructions(chats(spark, d)).select("conv_id", "turn", "role")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations WHERE role = 'user' GROUP BY 1")
def p11_text_content(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.struct(F.when(F.col("role") == "user", "text").otherwise("image").alias("kind"), "text").alias("c"))))
    content = chats(spark, d).groupBy("conv_id").agg(F.transform(parts, lambda x: x["c"]).alias("content"))
    return content.select("conv_id", C.text_content(F.col("content")).alias("content")).where("content is not null")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'")
def p17_export_round_trip(spark, d):
    """To JSON without the excluded items, and back."""
    return C.imported(C.exported(chats(spark, d), "system"))


@query("""WITH a AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, text FROM conversations),
b AS (SELECT conv_id, turn, id, CASE WHEN turn = 2 THEN text || '!' ELSE text END AS text FROM a WHERE turn <> 1 UNION ALL SELECT conv_id, 99, id || '-new', text FROM a WHERE turn = 0),
n AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_id FROM b)
SELECT conv_id, 'remove' AS action, id, NULL AS previous_id FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT conv_id, 'create', id, previous_id FROM n WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT n.conv_id, 'update', n.id, previous_id FROM n JOIN a ON a.id = n.id AND a.text <> n.text""")
def w13_edit_script(spark, d):
    a = chats(spark, d).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    b = a.where("turn <> 1").withColumn("text", F.when(F.col("turn") == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).unionByName(a.where("turn = 0").withColumn("turn", F.lit(99).cast("long")).withColumn("id", F.concat("id", F.lit("-new"))))
    return C.edit_script(a, b)


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2 = 0, turn) - 1 AS position, turn::VARCHAR AS id FROM conversations WHERE turn <> 1")
def w15_list_replay(spark, d):
    rows = chats(spark, d).select("conv_id", F.col("turn").alias("seq"), F.lit("insert").alias("action"), F.col("turn").cast("string").alias("id"), F.when(F.col("turn") > 1, (F.col("turn") - 2).cast("string")).alias("previous_id"))
    gone = rows.where("seq = 1").select("conv_id", F.lit(99).cast("long").alias("seq"), F.lit("delete").alias("action"), "id", "previous_id")
    return C.replayed(rows.unionByName(gone))
