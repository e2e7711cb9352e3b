"""Queries on corpus upkeep and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import vectors as V
from skein.operators import chunking
from skein.operators import corpus as O
from skein.plans.registry import query, table
from skein.plans.text import strip
from skein.sources import scratch


def docs(spark, d):
    return table(spark, d, "documents")


FILES = """now AS (SELECT 'f' || doc_id AS file_name, n_chars + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS size, doc_id AS mtime, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 7),
history AS (SELECT 'f' || doc_id AS file_name, n_chars AS size, doc_id AS mtime, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 5)"""


def files(spark, d):
    """Documents as files: a tenth changed, a tenth new, a tenth deleted."""
    f = docs(spark, d).select("doc_id", F.concat(F.lit("f"), "doc_id").alias("file_name"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), F.sha2("text", 256).alias("sha256"))
    now = f.where("doc_id % 10 <> 7").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0))
    return now.drop("doc_id"), f.where("doc_id % 10 <> 5").drop("doc_id")


PARTS = f"parts AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){X.SPACE}+', '\\1' || chr(57345), 'g'), chr(57345)), lambda s: {strip('s')}), lambda s: s <> '') AS p FROM documents))"


def parts(spark, d):
    """Sentences as the chunks of a document, which SQL can make too."""
    return docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "text"))


@query(f"WITH {PARTS} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, round(count(*) / count(DISTINCT doc_id), 6) AS chunks_per_document, round(avg(length(text) // 4), 6) AS mean_tokens, min(length(text) // 4) AS least_tokens, max(length(text) // 4) AS most_tokens FROM parts")
def a1_corpus_statistics(spark, d):
    out = O.corpus_statistics(parts(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("chunks_per_document", "mean_tokens")})


@query(f"WITH {PARTS} SELECT doc_id, count(*) AS chunks FROM parts GROUP BY 1")
def a2_chunks_per_document(spark, d):
    return O.chunk_counts(parts(spark, d))


CJK = "regexp_extract_all(text || CASE WHEN doc_id % 3 = 0 THEN '中文' || chr(12354 + (doc_id % 40)::INT) ELSE '' END, '[\\x{3000}-\\x{FAFF}\\x{FB05}-\\x{10FFFF}]')"


def damaged(spark, d):
    """A third of the texts get CJK characters, as the corpus has none."""
    pool = "".join(chr(12354 + i) for i in range(40))
    extra = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("中文"), F.substring(F.lit(pool), (F.col("doc_id") % 40 + 1).cast("int"), F.lit(1)))).otherwise("")
    return docs(spark, d).withColumn("text", F.concat("text", extra))


@query(f"SELECT source, count(*) AS n, sum((len({CJK}) > 0)::INT)::BIGINT AS corrupted, round(avg((len({CJK}) > 0)::INT), 6) AS rate FROM documents GROUP BY 1")
def a7_corruption_by_source(spark, d):
    return O.corruption(damaged(spark, d), "source", X.unsafe_characters(F.col("text"))).withColumn("rate", F.round("rate", 6))


@query(f"SELECT c AS character, count(*) AS texts FROM (SELECT unnest(list_distinct({CJK})) AS c FROM documents) GROUP BY 1 ORDER BY texts DESC, character LIMIT 20")
def a7_character_frequency(spark, d):
    return O.character_frequency(damaged(spark, d), X.unsafe_characters(F.col("text")))


STATUS = "CASE WHEN n_chars < 40 THEN 'failed' WHEN n_chars > 10000 THEN 'split' ELSE 'ok' END"


def reported(spark, d):
    status = F.when(F.col("n_chars") < 40, "failed").when(F.col("n_chars") > 10_000, "split").otherwise("ok")
    return docs(spark, d).select("doc_id", F.ceil(F.col("n_chars") / 512).alias("chunks"), status.alias("status"))


@query(f"SELECT count(*) AS files, sum(ceil(n_chars / 512.0))::BIGINT AS chunks, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'split') AS split, sum(CASE WHEN status = 'ok' THEN ceil(n_chars / 512.0) ELSE 0 END)::BIGINT AS ok_chunks FROM (SELECT *, {STATUS} AS status FROM documents)")
def a9_report_summary(spark, d):
    return O.report_summary(reported(spark, d))


@query(f"SELECT doc_id, ceil(n_chars / 512.0)::BIGINT AS chunks FROM documents WHERE {STATUS} = 'failed'")
def a9_failures(spark, d):
    """The list of failures, as rows, as it grows with the table."""
    return O.failures(reported(spark, d)).select("doc_id", "chunks")


@query(f"WITH {PARTS} SELECT doc_id, i - 1 AS i, ((row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) // 30)::BIGINT AS batch FROM parts")
def a11_batches_for_dedup(spark, d):
    return O.batches_of(parts(spark, d), "doc_id", "i").select("doc_id", "i", "batch")


@query(f"WITH {FILES} SELECT n.file_name FROM now n LEFT JOIN history h USING (file_name, size, mtime, sha256) WHERE h.file_name IS NULL".replace("LEFT JOIN history h USING (file_name, size, mtime, sha256) WHERE h.file_name IS NULL", "WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.file_name = n.file_name AND h.size = n.size AND h.mtime = n.mtime AND h.sha256 = n.sha256)"))
def j6_changed_files(spark, d):
    return O.changed_files(*files(spark, d)).select("file_name")


@query(f"WITH {FILES} SELECT 'f' || doc_id AS file_name, doc_id FROM documents WHERE EXISTS (SELECT 1 FROM now n JOIN history h ON h.file_name = n.file_name AND h.size = n.size AND h.mtime = n.mtime AND h.sha256 = n.sha256 WHERE n.file_name = 'f' || doc_id)")
def j7_carried_forward(spark, d):
    chunks = docs(spark, d).select(F.concat(F.lit("f"), "doc_id").alias("file_name"), "doc_id")
    return O.kept_chunks(chunks, *files(spark, d)).select("file_name", "doc_id")


@query(f"WITH {FILES} SELECT file_name FROM history EXCEPT SELECT file_name FROM now")
def j8_deleted_files(spark, d):
    return O.deleted_files(*files(spark, d))


@query(f"WITH {FILES} SELECT file_name FROM now EXCEPT SELECT file_name FROM history")
def e3_new_files(spark, d):
    now, history = files(spark, d)
    return now.select("file_name").subtract(history.select("file_name"))


@query("SELECT md5(text) AS md5 FROM documents WHERE doc_id >= 300 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 300) GROUP BY 1")
def e4_unseen_texts(spark, d):
    rows = docs(spark, d)
    return O.unseen(rows.where("doc_id >= 300"), rows.where("doc_id < 300").select(F.md5("text").alias("md5"))).select("md5")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, lang FROM documents WHERE n_chars < 2000")
def e5_concatenated_lists(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", "n_chars")
    return rows.where("lang = 'de'").union(rows.where("n_chars < 2000")).select("doc_id", "lang")


@query("WITH q AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user') SELECT conv_id, turn, md5(question) AS question, md5(answer) AS context FROM q WHERE answer IS NOT NULL")
def s8_load_qa_pairs(spark, d):
    """Each conversation as one JSON file of pairs; the context is the answer where it lacks."""
    c = table(spark, d, "conversations")
    u, a = c.where("role = 'user'").alias("u"), c.where("role = 'assistant'").alias("a")
    qa = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1), "left").select("u.conv_id", "u.turn", F.col("u.text").alias("question"), F.col("a.text").alias("answer"))
    packed = qa.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct("turn", "question", "answer")).alias("qa_pairs"))).alias("j"))
    from skein.sources.readers import qa_rows

    return qa_rows(packed.select("conv_id", "j"), "j").select("conv_id", "turn", F.md5("question").alias("question"), F.md5("context").alias("context"))


@query(r"SELECT doc_id, source || '#' || CASE WHEN doc_id < 1000000 THEN lpad(doc_id::VARCHAR, 6, '0') ELSE doc_id::VARCHAR END || ': ' || replace(replace(replace(text, '\', '\\'), chr(13), '\r'), chr(10), '\n') AS line FROM documents")
def s12_text_export(spark, d):
    from skein.sources.sinks import export_lines

    return export_lines(docs(spark, d)).select("doc_id", "line")


@query("SELECT c_custkey, c_name || ',signed up' AS log FROM customer WHERE c_custkey = 7")
def s15_point_lookup(spark, d):
    """One account by its key, pushed down to the scan, and an entry appended to its list."""
    found = O.point_lookup(table(spark, d, "customer"), "c_custkey", 7).withColumn("log", F.array("c_name"))
    return found.select("c_custkey", F.array_join(F.array_append("log", F.lit("signed up")), ",").alias("log"))


@query("""WITH t AS (SELECT 'User' || c_custkey || '@X.org' AS email, 's' || c_nationkey AS site, c_name AS display_name, 'active' AS status, c_mktsegment AS plan, c_custkey AS expires_at FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT 'user' || c_custkey || '@x.ORG' AS email, 's' || c_nationkey AS site, CASE WHEN c_custkey % 4 = 0 THEN 'new' END AS display_name, 'paid' AS status, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'pro' END AS plan, NULL::BIGINT AS expires_at FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(lower(t.email), lower(n.email)) AS email, coalesce(t.site, n.site) AS site, coalesce(n.display_name, t.display_name) AS display_name, CASE WHEN n.status IS NOT NULL THEN n.status ELSE t.status END AS status, CASE WHEN n.status IS NOT NULL THEN n.plan ELSE t.plan END AS plan, CASE WHEN n.status IS NOT NULL THEN n.expires_at ELSE t.expires_at END AS expires_at FROM t FULL JOIN n ON lower(t.email) = lower(n.email) AND t.site = n.site""")
def s16_subscription_upsert(spark, d):
    c = table(spark, d, "customer")
    site = F.concat(F.lit("s"), "c_nationkey").alias("site")
    t = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("User"), "c_custkey", F.lit("@X.org")).alias("email"), site, F.col("c_name").alias("display_name"), F.lit("active").alias("status"), F.col("c_mktsegment").alias("plan"), F.col("c_custkey").cast("long").alias("expires_at"))
    n = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("user"), "c_custkey", F.lit("@x.ORG")).alias("email"), site, F.when(F.col("c_custkey") % 4 == 0, "new").alias("display_name"), F.lit("paid").alias("status"), F.when(F.col("c_custkey") % 5 != 0, "pro").alias("plan"), F.lit(None).cast("long").alias("expires_at"))
    return O.upserted(t, n)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def k9_largest(spark, d):
    return docs(spark, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.2f B', n_chars::DOUBLE) ELSE printf('%.2f KB', round(n_chars / 1024.0, 2)) END AS size FROM documents")
def f_byte_size(spark, d):
    return docs(spark, d).select("doc_id", X.byte_size(F.col("n_chars")).alias("size"))


@query("SELECT vec_id, len(list_concat(embedding, list_resize([0.0::FLOAT], 100))[1:80]) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings".replace("len(list_concat(embedding, list_resize([0.0::FLOAT], 100))[1:80])", "80::BIGINT"))
def f_fit_to_dimension(spark, d):
    v = V.fitted(F.transform("embedding", lambda x: x.cast("double")), 80)
    return table(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("dim"), F.round(V.total(v), 6).alias("total"))


@query("SELECT DISTINCT user_id, ['Hello', 'Welcome', 'Good to see you'][('0x' || left(md5(user_id::VARCHAR), 8))::BIGINT % 3 + 1] AS opener FROM events")
def k7_random_pick(spark, d):
    """One of several openers for each user, the same on every run."""
    openers = F.array(*(F.lit(x) for x in ("Hello", "Welcome", "Good to see you")))
    return table(spark, d, "events").select("user_id").distinct().withColumn("opener", O.picked(openers, "user_id"))


@query()
def a10_greedy_near_duplicates(spark, d):
    """Word-hash vectors stand in for embeddings; the chunks of a document are compared."""
    rows = O.through_model(chunking.good_chunks(docs(spark, d)), "text", O.hashed_embedding(256), "vector", "array<double>")
    return O.near_copies(rows.select("doc_id", "chunk_index", "vector"), "doc_id", "chunk_index", "vector")


@query()
def s13_embed_texts(spark, d):
    rows = O.through_model(docs(spark, d).select("doc_id", "text"), "text", O.hashed_embedding(), "embedding", "array<double>")
    return rows.select("doc_id", F.size("embedding").alias("dim"))


@query("""WITH RECURSIVE v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
s AS (SELECT b.label, b.i, list(a.i) FILTER (list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) > 0.25) AS near FROM v b LEFT JOIN v a ON a.label = b.label AND a.i < b.i GROUP BY 1, 2),
r AS (SELECT DISTINCT label, 0::BIGINT AS i, []::BIGINT[] AS kept FROM v UNION ALL SELECT s.label, s.i, CASE WHEN list_has_any(r.kept, coalesce(s.near, [])) THEN r.kept ELSE list_append(r.kept, s.i) END FROM r JOIN s ON s.label = r.label AND s.i = r.i + 1)
SELECT v.label, v.vec_id FROM v JOIN (SELECT label, unnest(kept) AS i FROM r WHERE (label, i) IN (SELECT label, max(i) FROM v GROUP BY 1)) k ON k.label = v.label AND k.i = v.i""")
def a10_greedy_vectors(spark, d):
    """Labels stand in for documents; fronts are small, so that every label takes several rounds."""
    return O.near_copies(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.25, block=16, spread=32)


def lengths(texts: list[str]) -> list[int]:
    """A model that SQL knows too."""
    return [len(t) for t in texts]


@query("SELECT doc_id, length(text) AS n, (SELECT count(DISTINCT text) FROM documents) AS known FROM documents")
def s10_memoised_model(spark, d):
    """Half of the documents, then all; the memo holds each different text once, and is compacted between the runs."""
    path = scratch.folder(spark, "s10")
    rows = docs(spark, d).select("doc_id", "text")
    O.memoised(rows.where("doc_id % 2 = 0"), "text", lengths, "n", "long", path, "length").count()
    O.compact_memo(spark, path, "long")
    found = O.memoised(rows, "text", lengths, "n", "long", path, "length")
    return found.select("doc_id", "n").crossJoin(F.broadcast(O.memo(spark, path, "long").agg(F.count(F.lit(1)).alias("known"))))  # one row
