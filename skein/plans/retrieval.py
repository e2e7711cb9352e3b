"""Queries on retrieval and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import vectors as V
from skein.operators import corpus, keyword_index, vector_index
from skein.operators import retrieval as R
from skein.plans.registry import query, table
from skein.sources import scratch

TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
#: BM25 of every fiftieth benchmark text over documents, as a chain of common table expressions ending in ``bm25``.
BM25 = rf"""
t AS (SELECT doc_id, {TERMS} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
h AS (SELECT doc_id, term, dl, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark WHERE item_id % 50 = 0) GROUP BY ALL),
n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_dl FROM t),
d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
bm25 AS (SELECT query_id, doc_id, round(sum(qf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score
  FROM h JOIN q USING (term) JOIN d USING (term), n GROUP BY 1, 2)
"""
#: Cosine of every fiftieth vector with all.
COSINE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
cos AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) AS score FROM v a, v b WHERE a.vec_id % 50 = 0)
"""


def asked(spark, d):
    """Every fiftieth benchmark text."""
    return table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, d):
    """All vectors, and every fiftieth as a query."""
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def index(spark, d):
    """The keyword index of all documents, written once for the files that are there."""
    return scratch.kept(spark, f"{d}/documents.parquet", "keyword-index", lambda path: keyword_index.add(table(spark, d, "documents"), path))


def keyword(spark, d):
    """Rounded, so that copies of a document tie however their terms are summed."""
    return keyword_index.search(spark, index(spark, d), asked(spark, d)).withColumn("score", F.round("score", 9))


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25.score DESC, doc_id) <= 10")
def k3_bm25_top_n(spark, d):
    return R.best(keyword(spark, d), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT DISTINCT term, df, round(avg_dl, 6) AS avg_dl FROM d JOIN q USING (term), n")
def a3_document_frequency(spark, d):
    path, queries = index(spark, d), asked(spark, d)
    wanted = R.query_terms(queries).select("term").distinct()
    found = keyword_index.postings(spark, path, buckets=keyword_index.asked_buckets(queries)).join(wanted, "term", "left_semi")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(keyword_index.size(spark, path))).select("term", "df", F.round("avg_dl", 6).alias("avg_dl"))  # one row


@query(rf"SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT doc_id, unnest({TERMS}) AS term, 1 AS tf FROM documents) GROUP BY 1".replace("count(*) AS df", "count(DISTINCT doc_id) AS df"))
def t9_index_terms(spark, d):
    p = R.postings(table(spark, d, "documents"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score, round(sqrt(greatest(0, 2 * (1 - score))), 4) AS distance FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos.score DESC, vec_id) BETWEEN 2 AND 11")
def k1_vector_top_k(spark, d):
    top = R.nearest(*vectors(spark, d), 11).where("rank >= 2")
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.round(R.angular(F.col("score")), 4).alias("distance"))


@query(f"WITH {COSINE}, top AS (SELECT * FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20) SELECT query_id, vec_id, round(score, 6) AS score FROM top WHERE score >= 0.25")
def k2_exact_cosine_then_threshold(spark, d):
    return R.relevant(R.nearest(*vectors(spark, d), 20), 0.25, inclusive=True).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {COSINE}, top AS (SELECT * FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 15) SELECT query_id, count(*) AS kept FROM top WHERE score > 0.28 GROUP BY 1")
def k5_over_fetch_then_filter(spark, d):
    return R.relevant(R.nearest(*vectors(spark, d), 5 * 3), 0.28).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score FROM cos WHERE score > 0.3")
def p5_relevance_threshold(spark, d):
    return R.above(*vectors(spark, d), 0.3).select("query_id", "vec_id", F.round("score", 6).alias("score"))


HYBRID = f"""WITH {BM25}, {COSINE},
s AS (SELECT query_id, vec_id AS id, score FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos.score DESC, vec_id) <= 40),
k AS (SELECT query_id, doc_id AS id, score FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25.score DESC, doc_id) <= 40),
sn AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM s WINDOW w AS (PARTITION BY query_id)),
kn AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM k WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, round(coalesce(sn.x, 0) * 0.7 + coalesce(kn.x, 0) * 0.3, 9) AS score FROM sn FULL JOIN kn USING (query_id, id))"""


def hybrid(spark, d):
    """The two lists of each query; texts and vectors are paired by id, which is synthetic, and a query may have one list only."""
    s = R.nearest(*vectors(spark, d), 40).select("query_id", F.col("vec_id").alias("id"), "score")
    k = R.best(keyword(spark, d), 40).select("query_id", F.col("doc_id").alias("id"), "score")
    return s, k


@query(f"{HYBRID} SELECT query_id, id, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, id) <= 20")
def k4_hybrid_fusion(spark, d):
    s, k = hybrid(spark, d)
    return R.best(R.fused(s, k).withColumn("score", F.round("score", 9)), 20, "id").select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"{HYBRID} SELECT query_id, id, round(x, 6) AS score FROM sn")
def a14_min_max_normalise(spark, d):
    return R.min_max(hybrid(spark, d)[0]).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"{HYBRID} SELECT query_id, id, round(coalesce(s.score, 0), 6) AS semantic, round(coalesce(k.score, 0), 6) AS keyword FROM s FULL JOIN k USING (query_id, id)")
def j4_outer_join_of_lists(spark, d):
    s, k = hybrid(spark, d)
    both = s.select("query_id", "id", F.col("score").alias("s")).join(k.select("query_id", "id", F.col("score").alias("k")), ["query_id", "id"], "full")
    return both.select("query_id", "id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("semantic"), F.round(F.coalesce("k", F.lit(0.0)), 6).alias("keyword"))


@query(f"{HYBRID} SELECT query_id, id FROM s UNION SELECT query_id, id FROM k")
def e1_union_of_ids(spark, d):
    s, k = hybrid(spark, d)
    return s.select("query_id", "id").union(k.select("query_id", "id")).distinct()


@query(f"WITH {COSINE}, m AS (SELECT vec_id, max(score) AS score FROM cos GROUP BY 1) SELECT vec_id, round(score, 6) AS score FROM m ORDER BY m.score DESC, vec_id LIMIT 15")
def k6_multi_query_top_k(spark, d):
    """All queries count as variants of one."""
    v, variants = vectors(spark, d)
    top = R.variant_top(v, variants.withColumn("variant", F.col("query_id")).withColumn("query_id", F.lit(0)), 15)
    return top.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {COSINE} SELECT vec_id, round(max(score), 6) AS score FROM cos GROUP BY 1")
def a13_max_score_per_id(spark, d):
    v, variants = vectors(spark, d)
    return R.variant_scores(v, variants.withColumn("query_id", F.lit(0))).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {COSINE}, hits AS (SELECT query_id, label AS source, vec_id AS chunk, score FROM cos JOIN embeddings USING (vec_id) WHERE score > 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk) AS r FROM hits)
SELECT query_id, source, round(max(score), 6) AS max_score, string_agg(chunk::VARCHAR, ',' ORDER BY r) AS chunks FROM r WHERE r <= 3 GROUP BY 1, 2""")
def a15_group_hits_by_document(spark, d):
    """Labels stand in for documents."""
    v, asked_vectors = vectors(spark, d)
    hits = R.best_by_source(v, asked_vectors, 3, 0.1, "label")
    return R.by_document(hits.withColumnRenamed("vec_id", "chunk")).withColumn("max_score", F.round("max_score", 6))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(list_min(e), 6) AS low, round(list_max(e), 6) AS high, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS deviation FROM v""")
def a19_vector_statistics(spark, d):
    e = F.col("embedding")
    mean = V.total(e) / F.size(e)
    spread = F.sqrt(F.greatest(V.dot(e, e) / F.size(e) - mean * mean, F.lit(0.0)))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(F.array_min(e).cast("double"), 6).alias("low"), F.round(F.array_max(e).cast("double"), 6).alias("high"), F.round(mean, 6).alias("mean"), F.round(spread, 6).alias("deviation"))


@query("SELECT vec_id, label FROM embeddings QUALIFY (row_number() OVER (ORDER BY vec_id) - 1) % 25 = 0")
def k8_every_nth(spark, d):
    """Places by two passes, so that no task orders all rows: counts by runs of ids, then places inside a run."""
    return corpus.every_nth(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 25, "label")


@query("WITH v AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, round(score, 6) AS score FROM v WHERE score > 0.3")
def j12_similar_pairs(spark, d):
    """Pairs are compared inside a label, which stands in for the document whose chunks are compared."""
    return R.similar_pairs(table(spark, d, "embeddings"), "label", 0.3).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, label, lang, n_chars FROM embeddings JOIN documents ON vec_id = doc_id")
def j1_hit_to_metadata(spark, d):
    return table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", "lang", "n_chars")


@query("SELECT doc_id, coalesce(quality::VARCHAR, 'No summary available') AS summary FROM documents LEFT JOIN labels USING (doc_id)")
def j2_summary_with_default(spark, d):
    found = corpus.with_default(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("summary")), "doc_id", "summary", "No summary available")
    return found.select("doc_id", "summary")


@query("SELECT vec_id, length(text) AS n FROM embeddings LEFT JOIN documents ON vec_id = doc_id")
def j3_chunk_to_document(spark, d):
    return table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"), "left").select("vec_id", F.length("text").cast("long").alias("n"))


@query(rf"WITH {BM25} SELECT query_id, doc_id, term, tf, qf FROM h JOIN q USING (term)")
def j5_query_terms_with_postings(spark, d):
    queries = asked(spark, d)
    rows = keyword_index.postings(spark, index(spark, d), buckets=keyword_index.asked_buckets(queries))
    return rows.join(R.query_terms(queries), "term").select("query_id", "doc_id", "term", "tf", "qf")


@query("SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + TERMS + ") AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def d6_write_keyword_index(spark, d):
    """An index written anew each time, for the cost of that, and read back whole."""
    path = scratch.folder(spark, "d6")
    keyword_index.add(table(spark, d, "documents"), path)
    return keyword_index.postings(spark, path).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


CHANGED = rf"""
now AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN reverse(text) || ' river river' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 5 = 1),
"""


@query("WITH" + CHANGED + BM25.replace("FROM documents", "FROM now").lstrip() + "SELECT query_id, doc_id, round(score, 6) AS score FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25.score DESC, doc_id) <= 10")
def d6_changed_keyword_index(spark, d):
    """X10. All documents are added in two batches, a seventh is deleted, a fifth replaced or added again, and half of the segments are merged before."""
    path = scratch.folder(spark, "d6-changed")
    docs = table(spark, d, "documents").select("doc_id", "text")
    keyword_index.add(docs.where("doc_id % 2 = 0"), path)
    keyword_index.add(docs.where("doc_id % 2 = 1"), path)
    keyword_index.delete(docs.where("doc_id % 7 = 3").select("doc_id"), path)
    keyword_index.merge(spark, path)
    keyword_index.add(docs.where("doc_id % 5 = 1").withColumn("text", F.concat(F.reverse("text"), F.lit(" river river"))), path)
    scored = keyword_index.search(spark, path, asked(spark, d)).withColumn("score", F.round("score", 9))
    return R.best(scored, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def leaves(spark, d):
    """The vector index of all vectors, written once for the files that are there."""
    return scratch.kept(spark, f"{d}/embeddings.parquet", "vector-index", lambda path: vector_index.write(table(spark, d, "embeddings"), path, leaf=64))


@query(f"WITH {COSINE} SELECT query_id, vec_id, round(score, 6) AS score FROM cos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos.score DESC, vec_id) BETWEEN 2 AND 11")
def d5_vector_index_whole(spark, d):
    """The index's exact way: every query reads all leaves."""
    path = leaves(spark, d)
    top = vector_index.search(spark, path, vectors(spark, d)[1], 11, vector_index.described(spark, path)["leaves"])
    return top.where("rank >= 2").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query()
def d5_vector_index(spark, d):
    """Each query reads its nearest leaves; tests hold the recall against the exact way."""
    top = vector_index.search(spark, leaves(spark, d), vectors(spark, d)[1], 11)
    return top.where("rank >= 2").select("query_id", "vec_id", F.round("score", 6).alias("score"))


BUDGET = 1_000


@query(f"""WITH i AS (SELECT lang, doc_id AS rank, text, length(text) // 4 AS n FROM documents),
s AS (SELECT *, sum(n) OVER w AS total FROM i WINDOW w AS (PARTITION BY lang ORDER BY rank)),
o AS (SELECT *, sum((total > {BUDGET})::INT) OVER (PARTITION BY lang ORDER BY rank) AS overs FROM s)
SELECT lang, rank, n::BIGINT AS n, overs = 1 AS truncated FROM o WHERE overs = 0 OR overs = 1 AND total > {BUDGET} AND {BUDGET} - (total - n) > 200""")
def w6_context_budget(spark, d):
    items = table(spark, d, "documents").select("lang", F.col("doc_id").alias("rank"), "text", X.tokens(F.col("text")).alias("n"))
    return R.within_budget(items, BUDGET, ("lang",)).select("lang", "rank", "n", "truncated")
