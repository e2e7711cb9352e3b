"""Queries on row-level text functions and tokenizers, with their SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import chunking, hyphenation, sentence_model
from skein.plans.registry import query, table

S = X.SPACE


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


CLEAN = f"regexp_replace(text, '\\.{{4,}}', '...', 'g')"
CLEAN = f"regexp_replace({CLEAN}, '[ \\t]{{4,}}', ' ', 'g')"
CLEAN = f"regexp_replace({CLEAN}, '\\n{{3,}}', E'\\n\\n', 'g')"
CLEAN = f"regexp_replace({CLEAN}, '(?m)^{S}*[0-9]{{1,3}}{S}*$', '', 'g')"
CLEAN = f"replace(replace(translate({CLEAN}, '{X.ODD_SPACES}{X.DASHES}', '   ---'), '­', ''), '…', '...')"
CLEAN = strip(f"regexp_replace({CLEAN}, '{S}+', ' ', 'g')")


def docs(spark, d):
    return table(spark, d, "documents")


def check(column):
    """A text as its digest and length, as whole texts make long rows."""
    return F.md5(column).alias("digest"), F.length(column).cast("long").alias("n")


@query(f"SELECT doc_id, md5({CLEAN}) AS digest, length({CLEAN}) AS n FROM documents")
def p1_clean_text(spark, d):
    return docs(spark, d).select("doc_id", *check(X.clean(F.col("text"))))


WORDS = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{2,}'))"


VALID = rf"""length({strip('text')}) >= 20 AND len({WORDS}) >= 5 AND length(text) - length(replace(text, '.', '')) <= 2 * len({WORDS})
  AND length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) <= length(text) * 0.3 AND length(array_to_string({WORDS}, '')) / greatest(len({WORDS}), 1) >= 2.5"""


@query(f"SELECT doc_id, {VALID} AS valid FROM documents")
def p2_valid_chunk(spark, d):
    return docs(spark, d).select("doc_id", X.valid_chunk(F.col("text")).alias("valid"))


SPOKEN = f"replace(translate(text, '{X.DASHES}{X.ODD_SPACES}', '---   '), '­', '')"
for _one, _two in {**X.LIGATURES, "…": "..."}.items():
    SPOKEN = f"replace({SPOKEN}, '{_one}', '{_two}')"
SPOKEN = f"regexp_replace({SPOKEN}, '[^\\x20-\\x7e\\n\\t\\rªµºÀ-ÖØ-öø-Ɏ{X.SPOKEN}]', ' ', 'g')"
SPOKEN = strip(f"regexp_replace({SPOKEN}, '{S}+', ' ', 'g')")


@query(f"SELECT doc_id, md5({SPOKEN}) AS digest, length({SPOKEN}) AS n FROM documents")
def p3_safe_for_speech(spark, d):
    return docs(spark, d).select("doc_id", *check(X.spoken(F.col("text"))))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html || CASE WHEN page_id % 3 > 0 THEN '中' || chr(12354 + (page_id % 40)::INT) || 'ﬁ' ELSE '' END, '[\\x{3000}-\\x{FAFF}\\x{FB05}-\\x{10FFFF}]'))), '') AS found FROM pages")
def p4_unsafe_characters(spark, d):
    """Two such characters and a ligature, which is allowed, are added to two thirds of the pages, as the corpus holds none."""
    pool = F.lit("".join(chr(12354 + i) for i in range(40)))
    extra = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("中"), F.substring(pool, (F.col("page_id") % 40 + 1).cast("int"), F.lit(1)), F.lit("ﬁ"))).otherwise("")
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(X.unsafe_characters(F.concat("html", extra))), "").alias("found"))


@query("SELECT page_id FROM pages WHERE url LIKE '%.html' OR url LIKE '%=feed'")
def p6_type_suffix_filter(spark, d):
    return table(spark, d, "pages").where(X.has_suffix(F.col("url"), (".html", "=feed"))).select("page_id")


QA = "SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"
FIRST = lambda marks: "coalesce(" + ", ".join(f"CASE WHEN contains(low, '{m}') THEN '{m}' END" for m in marks) + ")"
#: The conversations hold none of the phrases; some are put in by turn.
PLANT = "' According to the report this is mandatory, otherwise it fails.'"


@query(f"""WITH qa AS ({QA}), x AS (SELECT conv_id, turn, {strip('question')} AS q, {strip("answer || CASE WHEN conv_id % 7 = 0 THEN ' According to the report.' WHEN conv_id % 7 = 1 THEN ' It is mandatory.' WHEN conv_id % 7 = 2 THEN ' It explicitly is mandatory.' ELSE '' END")} AS a FROM qa),
y AS (SELECT *, lower(a) AS low FROM x)
SELECT conv_id, turn, CASE WHEN q = '' OR a = '' THEN 'empty' WHEN floor(len(regexp_extract_all(q, '[^{S[1:-1]}]+')) * 1.3) > 60 THEN 'too long' WHEN {FIRST(X.FILLERS)} IS NOT NULL THEN 'filler: ' || {FIRST(X.FILLERS)}
 WHEN {FIRST(X.ASSUMPTIONS)} IS NOT NULL AND NOT ({' OR '.join(f"contains(low, '{c}')" for c in X.CITATIONS)}) THEN 'assumption: ' || {FIRST(X.ASSUMPTIONS)} END AS reason FROM y""")
def p7_qa_rules(spark, d):
    c = table(spark, d, "conversations")
    u, a = c.alias("u"), c.alias("a")
    qa = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1) & (F.col("u.role") == "user") & (F.col("a.role") == "assistant"))
    by = F.col("u.conv_id") % 7
    planted = F.concat("a.text", F.when(by == 0, " According to the report.").when(by == 1, " It is mandatory.").when(by == 2, " It explicitly is mandatory.").otherwise(""))
    return qa.select("u.conv_id", "u.turn", X.qa_verdict(F.col("u.text"), planted).alias("reason"))


@query("SELECT doc_id, substring(text, greatest(i - 80, 1), least(i + 88, length(text) + 1) - greatest(i - 80, 1)) AS context FROM (SELECT *, instr(lower(text), 'licensed') AS i FROM documents) WHERE i > 0")
def p8_substring_search(spark, d):
    return docs(spark, d).select("doc_id", X.context_of(F.col("text"), "licensed", 80).alias("context")).where("context is not null")


@query("SELECT page_id, CASE WHEN room LIKE '%\\_conversation%' ESCAPE '\\' THEN split_part(room, '_conversation', 1) ELSE split_part(room, '_', 1) END AS user_id FROM (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') || CASE WHEN page_id % 2 = 0 THEN '_conversation_1' ELSE '' END AS room FROM pages)")
def p12_room_to_user(spark, d):
    room = F.concat(F.regexp_replace("url", "[^A-Za-z0-9]", "_"), F.when(F.col("page_id") % 2 == 0, "_conversation_1").otherwise(""))
    rows = table(spark, d, "pages").select("page_id", room.alias("room"))
    return rows.select("page_id", X.user_of_room(F.col("room")).alias("user_id"))


@query("SELECT event_id, CASE WHEN value < 5 THEN 'invalid' WHEN ts < TIMESTAMP '2024-01-10' THEN 'expired' WHEN user_id % 3 = 0 THEN 'wrong site' WHEN user_id % 5 = 0 THEN 'wrong device' ELSE 'ok' END AS outcome FROM events")
def p13_token_validity(spark, d):
    outcome = X.first_reason((F.col("value") < 5, "invalid"), (F.col("ts") < F.lit("2024-01-10").cast("timestamp"), "expired"), (F.col("user_id") % 3 == 0, "wrong site"), (F.col("user_id") % 5 == 0, "wrong device"))
    return table(spark, d, "events").select("event_id", outcome.alias("outcome"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(replace(url, '/', '_'), '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '._') AS file_name FROM pages")
def p14_secure_file_name(spark, d):
    return table(spark, d, "pages").select("page_id", X.secure_name(F.col("url")).alias("file_name"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 10 <> 0 THEN (props::JSON->>'k')::BIGINT END, -1) AS k FROM events")
def p15_json_with_fallback(spark, d):
    """Every tenth row's JSON is broken first; it falls back."""
    broken = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", X.json_field(broken, "k", "bigint", -1).alias("k"))


@query(r"SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_full_match(w, '[A-Za-z0-9][A-Za-z0-9.\-_+%]*@(?:[A-Za-z0-9]+\.)+[A-Za-z]{2,}')) AS good FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n]*@[^ \t\n]*')) AS w FROM documents) GROUP BY 1")
def p18_email_syntax(spark, d):
    found = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n]*@[^ \t\n]*"), F.lit(0))).alias("w"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.email_ok(F.col("w"))).alias("good"))


@query(rf"SELECT conv_id, turn, len(list_filter(list_transform(regexp_extract_all(text, '[^{S[1:-1]}]+'), lambda w: regexp_replace(w, '[!-/:-@\[-`{{-~]', '', 'g')), lambda w: w <> '')) >= 40 AND length(text) / 15.0 >= 10 AS interrupts FROM conversations")
def p19_interruption_gate(spark, d):
    """Fifteen characters stand in for a second of speech."""
    gate = X.interrupts(F.col("text"), F.length("text") / 15.0, 40, 10)
    return table(spark, d, "conversations").select("conv_id", "turn", gate.alias("interrupts"))


@query("""WITH r AS (SELECT event_id, 'room' || (event_id % 9) || '::user' || user_id || '::' || upper(event_type) AS room FROM events), s AS (SELECT 'click' AS speaker, 'Ada' AS name UNION ALL SELECT 'View', 'Bo')
SELECT event_id, split_part(room, '::', 2) AS user_name, coalesce(name, 'default') AS speaker FROM r LEFT JOIN s ON lower(split_part(room, '::', 3)) = lower(s.speaker)""")
def p20_structured_room(spark, d):
    room = F.concat(F.lit("room"), F.col("event_id") % 9, F.lit("::user"), F.col("user_id"), F.lit("::"), F.upper("event_type"))
    rows = table(spark, d, "events").select("event_id", room.alias("room"))
    names = spark.createDataFrame([("click", "Ada"), ("View", "Bo")], "speaker string, name string").select(F.lower("speaker").alias("_s"), "name")
    return rows.join(names, F.lower(X.part_of_room(F.col("room"), 3)) == F.col("_s"), "left").select("event_id", X.part_of_room(F.col("room"), 2).alias("user_name"), F.coalesce("name", F.lit("default")).alias("speaker"))


@query(rf"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){S}+', '\1' || chr(57345), 'g'), chr(57345)), lambda s: {strip('s')}), lambda s: s <> '')) AS n FROM documents")
def t1_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query(rf"SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^{S[1:-1]}]+'), lambda w: regexp_replace(w, '[!-/:-@\[-`{{-~]', '', 'g')), lambda w: w <> ''), ' ')) AS digest FROM documents")
def t4_words(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.array_join(X.words(F.col("text")), " ")).alias("digest"))


@query(rf"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\n[ \t\r\f\x0B]*\n'), lambda s: {strip('s')}), lambda s: s <> '')) AS n FROM documents")
def t5_paragraphs(spark, d):
    """Sentences are set apart by blank lines first, as the corpus has none."""
    return docs(spark, d).select("doc_id", F.size(X.paragraphs(F.replace("text", F.lit(". "), F.lit(".\n\n")))).cast("long").alias("n"))


@query(rf"SELECT doc_id, length(text) // 4 AS by_chars, floor(len(regexp_extract_all(text, '[^{S[1:-1]}]+')) * 1.3 + 2)::BIGINT AS by_words FROM documents")
def t10_token_counts(spark, d):
    return docs(spark, d).select("doc_id", X.tokens(F.col("text")).alias("by_chars"), X.word_tokens(F.col("text"), 2).alias("by_words"))


@query("SELECT doc_id, chunk, CASE WHEN total > 1 THEN ' (Deel ' || chunk || '/' || total || ', ' || CASE WHEN a = b THEN 'Pagina ' || a ELSE 'Pagina''s ' || a || '-' || b END || ')' ELSE '' END AS title FROM (SELECT doc_id, doc_id % 3 + 1 AS chunk, doc_id % 4 + 1 AS total, doc_id AS a, doc_id + doc_id % 2 AS b FROM documents)")
def t13_chunk_title(spark, d):
    rows = docs(spark, d).select("doc_id", (F.col("doc_id") % 3 + 1).alias("chunk"), (F.col("doc_id") % 4 + 1).alias("total"), F.col("doc_id").alias("a"), (F.col("doc_id") + F.col("doc_id") % 2).alias("b"))
    return rows.select("doc_id", "chunk", chunking.title(F.col("chunk"), F.col("total"), F.col("a"), F.col("b")).alias("title"))


LAST = lambda m: f"(length(c) - instr(reverse(c), reverse({m})) - length({m}) + 1)"
CUT = " ".join(f"WHEN instr(c, {m}) > 0 AND {LAST(m)} > 640 THEN substring(c, 1, {LAST(m)} + length({m}))" for m in ("'. '", "'? '", "'! '", "chr(10) || chr(10)"))


@query(f"SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, CASE WHEN length(text) <= 800 THEN text {CUT} ELSE regexp_replace(c, '{S}+$', '') || '...' END AS t FROM (SELECT *, substring(text, 1, 800) AS c FROM documents))".replace("chr(10) || chr(10))", "(chr(10) || chr(10)))").replace("instr(c, chr(10) || chr(10)", "instr(c, chr(10) || chr(10)"))
def t15_truncate_to_tokens(spark, d):
    return docs(spark, d).select("doc_id", *check(X.truncated(F.col("text"), 200)))


@query("SELECT doc_id, md5(regexp_replace(text || ' \U0001f600❤️!', '[\\x{1F000}-\\x{1FBFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE00}-\\x{FE0F}\\x{200D}\\x{20E3}]+', '', 'g')) AS digest FROM documents")
def n3_without_emoji(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.without_emoji(F.concat("text", F.lit(" \U0001f600❤️!")))).alias("digest"))


MARKERS = lambda marks: " + ".join(f"contains(s, ' {m} ')::INT" for m in marks)


@query(f"WITH x AS (SELECT doc_id, lower(substring(CASE WHEN doc_id % 3 = 0 THEN 'wij zijn niet voor het energie jaar van de een ' || text ELSE text END, 1, 3000)) AS s FROM documents), y AS (SELECT doc_id, {MARKERS(X.DUTCH)} AS nl, {MARKERS(X.ENGLISH)} AS en FROM x) SELECT doc_id, CASE WHEN nl > en * 1.5 THEN 'Dutch' WHEN en > nl * 1.5 THEN 'English' ELSE 'Dutch' END AS language FROM y")
def n6_language(spark, d):
    """A third of the texts get Dutch words in front, as the corpus has no Dutch."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("wij zijn niet voor het energie jaar van de een "), "text")).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", X.language(text).alias("language"))


@query("SELECT conv_id, turn, turn % 4 <> 2 AND turn % 4 <> 3 AND regexp_matches(text, '[.!?]$') AS done FROM conversations")
def n7_end_of_turn(spark, d):
    """Every fourth turn ends in blanks, the next lacks its last character, the one after goes on."""
    by = F.col("turn") % 4
    text = F.when(by == 1, F.concat("text", F.lit(" \n"))).when(by == 2, F.concat(F.regexp_replace("text", "[.!?]+$", ""), F.lit("x"))).when(by == 3, F.concat("text", F.lit(" and"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.ends_turn(text).alias("done"))


@query("WITH s AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN '__ASSISTANT__' ELSE role END AS speaker FROM conversations) SELECT conv_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn) AS script FROM s WHERE NOT regexp_full_match(speaker, '__[A-Z0-9_]{2,}__') GROUP BY 1")
def n8_speakers(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.when(F.col("role") == "assistant", "__ASSISTANT__").otherwise(F.col("role")).alias("speaker"))
    rows = rows.where(~X.ignored_speaker(F.col("speaker")))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("speaker", F.lit(": "), "text").alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("script"))


@query("SELECT doc_id, nullif(regexp_extract('Report ' || (1990 + doc_id % 40) || '-x' || (2000 + doc_id % 30) || ' b', '(?:^|[^0-9A-Za-z_])(20[0-9]{2})(?:[^0-9A-Za-z_]|$)', 1), '') AS year FROM documents")
def s5_year_from_title(spark, d):
    name = F.concat(F.lit("Report "), 1990 + F.col("doc_id") % 40, F.lit("-x"), 2000 + F.col("doc_id") % 30, F.lit(" b"))
    return docs(spark, d).select("doc_id", X.year_of(name).alias("year"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def s7_fingerprint(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query()
def t3_rule_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(chunking.rule_sentences(F.col("text"))).alias("position", "sentence"))


def packed(chars: int) -> str:
    """Sentences as pieces that keep the white space behind them, so that their lengths add up to places; a chunk ends before the first sentence over its target."""
    return rf"""WITH RECURSIVE t AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]){S}+', '\0' || chr(57345), 'g'), chr(57345)) AS p FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM t),
o AS (SELECT doc_id, i, piece, {strip('piece')} AS s, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece))::BIGINT AS begins FROM u),
k AS (SELECT doc_id, list(s ORDER BY i) AS s, list(begins + length(piece) - length(regexp_replace(piece, '^{S}+', '')) ORDER BY i) AS a FROM o WHERE s <> '' GROUP BY 1),
l AS (SELECT *, len(s) AS n, list_prepend(0, (SELECT list(x ORDER BY j) FROM (SELECT j, sum(length(s[j])) OVER (ORDER BY j) AS x FROM range(1, len(s) + 1) r(j)))::BIGINT[])::BIGINT[] AS c FROM k),
r AS (SELECT doc_id, 0 AS chunk, 0::BIGINT AS first, e AS ends FROM (SELECT doc_id, coalesce(list_min(list_filter(range(1, n), lambda j: c[j + 2] > {chars})), n) AS e FROM l)
UNION ALL SELECT doc_id, chunk + 1, back, coalesce(list_min(list_filter(range(ends + 1, n), lambda j: c[j + 2] - c[back + 1] > {chars})), n) FROM (SELECT r.doc_id, chunk, ends, ends - floor((ends - first) * 0.25)::BIGINT AS back, n, c FROM r JOIN l USING (doc_id) WHERE ends < n)),
x AS (SELECT doc_id, chunk AS chunk_index, array_to_string(s[(first + 1)::BIGINT:ends], ' ') AS joined, (c[ends + 1] - c[first + 1]) / 4.0 AS est_tokens, a[first + 1] AS char_start, a[ends] + length(s[ends]) AS char_end FROM r JOIN l USING (doc_id))"""


@query(f"{packed(512)} SELECT doc_id, chunk_index, text, est_tokens, char_start, char_end, truncated FROM (SELECT *, left(joined, 520) AS text, length(joined) > 520 AS truncated FROM x) WHERE {VALID}")
def t11_chunks(spark, d):
    return chunking.good_chunks(docs(spark, d))


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\n[ \t\r\f\x0B]*\n'), lambda p: {strip('p')}), lambda p: p <> '') AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM t),
l AS (SELECT doc_id, p, len(p) AS n, list_prepend(0, c)::BIGINT[] AS c FROM t JOIN (SELECT doc_id, list(x ORDER BY i) AS c FROM (SELECT doc_id, i, sum(length(s) // 4) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM u) GROUP BY 1) USING (doc_id)),
r AS (SELECT doc_id, 1 AS chunk, 0::BIGINT AS first, e AS ends FROM (SELECT doc_id, coalesce(list_min(list_filter(range(1, n), lambda j: c[j + 2] > 400)), n) AS e FROM l)
UNION ALL SELECT doc_id, chunk + 1, back, coalesce(list_min(list_filter(range(ends + 1, n), lambda j: c[j + 2] - c[back + 1] > 400)), n) FROM (SELECT r.doc_id, chunk, ends, list_min(list_filter(range(first + 1, ends + 1), lambda b: c[ends + 1] - c[b + 1] <= 60)) AS back, n, c FROM r JOIN l USING (doc_id) WHERE ends < n)),
x AS (SELECT doc_id, chunk AS chunk_num, (max(chunk) OVER (PARTITION BY doc_id))::INT AS total_chunks, first, ends - 1 AS last, c[ends + 1] - c[first + 1] AS tokens, array_to_string(p[(first + 1)::BIGINT:ends], chr(10) || chr(10)) AS text FROM r JOIN l USING (doc_id))
SELECT *, CASE WHEN total_chunks > 1 THEN ' (Deel ' || chunk_num || '/' || total_chunks || ', ' || CASE WHEN first = last THEN 'Pagina ' || (first + 1) ELSE 'Pagina''s ' || (first + 1) || '-' || (last + 1) END || ')' ELSE '' END AS title FROM x""")
def t12_section_chunks(spark, d):
    rows = docs(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return chunking.section_chunks(rows, target=400, overlap=60)


def snapped() -> tuple[str, str]:
    """Where the text before and after a chunk is cut: at the first kind of border that it has."""
    at = lambda m: "chr(10) || chr(10)" if m == "\n\n" else "chr(10)" if m == "\n" else f"'{m}'"
    left = [f"WHEN instr(before, {at(m)}) > 0 THEN length(before) - instr(reverse(before), reverse({at(m)})) + 1" for m in chunking.MARKS]
    right = [f"WHEN instr(behind, {at(m)}) > 0 THEN instr(behind, {at(m)}) - 1 + {len(m.rstrip())}" for m in chunking.MARKS]
    return f"CASE {' '.join(left)} ELSE 0 END", f"CASE {' '.join(right)} ELSE length(behind) END"


@query(f"""{packed(160)},
e0 AS (SELECT doc_id, chunk_index, left(joined, 200) AS text, t.text AS whole, char_start, char_end, 512 - length(left(joined, 200)) AS room FROM x JOIN t USING (doc_id)),
e1 AS (SELECT *, greatest(0, char_start - least(256, room // 4) * 4) AS l, least(length(whole), char_end + least(256, room // 4) * 4) AS r FROM e0),
e2 AS (SELECT *, substr(whole, l + 1, char_start - l) AS before, substr(whole, char_end + 1, r - char_end) AS behind FROM e1),
e3 AS (SELECT *, CASE WHEN l > 0 THEN {snapped()[0]} ELSE 0 END AS cl, CASE WHEN r < length(whole) THEN {snapped()[1]} ELSE length(behind) END AS cr FROM e2),
e4 AS (SELECT *, {strip('substr(before, (cl + 1)::BIGINT)')} AS pre, {strip('substr(behind, 1, cr::BIGINT)')} AS post FROM e3),
e5 AS (SELECT *, CASE WHEN pre <> '' OR post <> '' THEN '[...' || pre || '] ' ELSE '' END AS head, CASE WHEN pre <> '' OR post <> '' THEN ' [' || post || '...]' ELSE '' END AS tail, room // 2 AS half FROM e4),
e6 AS (SELECT *, head || text || tail AS wide, CASE WHEN length(head) > half THEN '...' || right(head, half) ELSE head END || text || CASE WHEN length(tail) > room - half THEN left(tail, room - half) || '...' ELSE tail END AS trimmed FROM e5)
SELECT doc_id, chunk_index, CASE WHEN room <= 50 THEN text WHEN length(wide) > 512 THEN left(CASE WHEN length(text) <= 256 THEN trimmed ELSE wide END, 512) ELSE wide END AS text FROM e6""")
def t14_context_expansion(spark, d):
    rows = docs(spark, d)
    parts = chunking.chunks(rows, target=40, hard=200)
    joined = parts.join(rows.select("doc_id", F.col("text").alias("full")), "doc_id")
    return chunking.expanded(joined).select("doc_id", "chunk_index", F.col("expanded").alias("text"))


@query("SELECT doc_id, md5('Title x' || chr(10) || translate(text, '#*_`~[]!>+<-', '') || ' not so') AS digest FROM documents")
def n1_plain_markdown(spark, d):
    """Marks are put around texts without any; the text has to come back."""
    bare = F.translate("text", "#*_`~[]!>+<-", "")
    return docs(spark, d).select("doc_id", F.md5(X.plain_markdown(F.concat(F.lit("# **Title** [x](y)\n- "), bare, F.lit(" _not_ `so`")))).alias("digest"))


@query(rf"SELECT conv_id, turn, {strip(rf"regexp_replace(regexp_replace(lower(text || ' (don''t) ok-ay'), '[^\P{{P}}''\-]', '', 'g'), '{S}+', ' ', 'g')")} AS text FROM conversations")
def n5_turn_text(spark, d):
    """Full-width letters and a ligature are added, which become plain ones."""
    text = F.concat("text", F.lit("\u3000（ｄｏｎ'ｔ） \u200aｏk-ay"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.turn_text(text).alias("text"))


#: Made-up patterns: letters with weights in their gaps.
PATTERNS = ("a1b", "1na", "n2at", "e1r", "er1i", "1ti", "ti2on.", "o1n2", "2st", "s1t3r", ".un3", "in1g", "l1l", "4lly.", "1ve.", "c1k", "h2e", "a3t2e")
WEIGHTED = ", ".join("('{}', [{}])".format(re.sub("[0-9]", "", p), ", ".join(x or "0" for x in re.split("[^0-9]", p))) for p in PATTERNS)


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word FROM documents), p(letters, gaps) AS (VALUES {WEIGHTED}),
i AS (SELECT word, unnest(range(length(word) + 2)) AS i FROM w WHERE length(word) > 4),
f AS (SELECT word, i, gaps, unnest(range(len(gaps))) AS j FROM i JOIN p ON substr('.' || lower(word) || '.', (i + 1)::BIGINT, length(letters)) = letters),
v AS (SELECT word, i + j - 1 AS place, max(gaps[j + 1]) AS weight FROM f GROUP BY 1, 2),
b AS (SELECT word, list(place ORDER BY place) AS places FROM v WHERE weight % 2 = 1 AND place BETWEEN 2 AND length(word) - 2 GROUP BY 1),
e AS (SELECT word, list_concat([0], coalesce(places, []), [length(word)]) AS e FROM w LEFT JOIN b USING (word))
SELECT word, array_to_string(list_transform(range(1, len(e)), lambda k: substr(word, e[k] + 1, e[k + 1] - e[k])), '-') AS hyphenated FROM e""")
def t7_hyphenation(spark, d):
    """The words of all documents by a small list of patterns."""
    words = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("word"))
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return hyphenation.hyphenated(words, patterns).select("word", F.array_join("pieces", "-").alias("hyphenated"))


BARE = r"regexp_replace(lower(t), '^[^\p{L}\p{N}.]+|[^\p{L}\p{N}.]+$', '', 'g')"


@query(rf"""WITH t AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^\t-\r ]+')) AS t FROM documents),
w AS (SELECT regexp_replace(b, '[.]$', '') AS word, suffix(b, '.') AS stop FROM (SELECT {BARE} AS b FROM t)),
c AS (SELECT word, count(*) AS n, count(*) FILTER (stop) AS k FROM w WHERE regexp_matches(word, '[\p{{L}}\p{{N}}]') GROUP BY 1),
s AS (SELECT sum(k)::DOUBLE / sum(n)::DOUBLE AS p FROM c),
x AS (SELECT word, n, k, length(word) - length(replace(word, '.', '')) AS dots, k * ln(p) + (n - k) * ln(greatest(1 - p, 1e-12)) AS chance, k * {math.log(0.99)!r} + (n - k) * {math.log(0.01)!r} AS held FROM c, s WHERE k > 0 AND NOT regexp_matches(word, '^[0-9.,]+$')),
y AS (SELECT word, -2 * (chance - held) * exp(-(length(word) - dots)) * (dots + 1) * pow(greatest(length(word) - dots, 1)::DOUBLE, (-(n - k))::DOUBLE) AS score FROM x)
SELECT word, round(score, 6) AS score FROM y WHERE score >= 0.3""")
def t2_abbreviations(spark, d):
    """What the learned sentence model takes for abbreviations, over the words of all documents."""
    found = sentence_model.abbreviations(sentence_model.counted(sentence_model.tokens(docs(spark, d))))
    return found.select("word", F.round("score", 6).alias("score"))


@query()
def t2_learned_sentences(spark, d):
    """Sentences by a model that was fitted on the same documents."""
    rows = docs(spark, d)
    model = sentence_model.fit(rows)
    return rows.select("doc_id", F.posexplode(sentence_model.sentences(F.col("text"), model)).alias("position", "sentence"))
