"""§2.12. What SQL can call: table functions for splitting texts and for search.

``register`` adds the splitters as Python table functions, to be joined laterally:

    SELECT d.doc_id, c.* FROM documents d, LATERAL text_chunks(d.text) c

``register_search`` adds keyword and vector search as SQL table functions over an index's views,
so that Spark plans them as it does the DataFrame forms:

    SELECT * FROM keyword_search('grain mill', 10)
    SELECT * FROM vector_search(ARRAY(0.1D, 0.2D), 10)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import chunking, keyword_index
from skein.operators import retrieval as R


@F.udtf(returnType="chunk_index int, text string, est_tokens double, char_start int, char_end int, truncated boolean")
class TextChunks:
    """T11. Sentences packed into chunks."""

    def eval(self, text: str):
        yield from chunking.pack_sentences(text or "")


@F.udtf(returnType="chunk_num int, total_chunks int, first int, last int, tokens bigint, text string")
class SectionChunks:
    """T12. Paragraphs packed into sections of ``target`` tokens with ``overlap``."""

    def eval(self, text: str, target: int, overlap: int):
        parts = [p for x in re.split(r"\n[ \t\r\f\x0b]*\n", text or "") if (p := x.strip())]
        found = chunking.pack_sections(parts, target, overlap)
        for n, first, last, tokens in found:
            yield n, len(found), first, last, tokens, "\n\n".join(parts[first : last + 1])


def register(spark: SparkSession, docs: DataFrame | None = None, key: str = "doc_id") -> None:
    """text_chunks(text) and section_chunks(text, target, overlap); with ``docs``, a view rule_sentences (T3) of key, position, sentence."""
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("section_chunks", SectionChunks)
    if docs is not None:
        docs.select(key, F.posexplode(chunking.rule_sentences(F.col("text"))).alias("position", "sentence")).createOrReplaceTempView("rule_sentences")


def register_search(spark: SparkSession, index: str | None = None, vectors: DataFrame | None = None, key: str = "doc_id") -> None:
    """keyword_search(query, n) over a written keyword index, vector_search(vector, n) over (vec_id, embedding)."""
    if index is not None:
        keyword_index.postings(spark, index, key).createOrReplaceTempView("keyword_postings")
        keyword_index.size(spark, index).createOrReplaceTempView("keyword_size")
        spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION keyword_search(query STRING, n INT) RETURNS TABLE ({key} BIGINT, score DOUBLE, rank INT) RETURN
            WITH q AS (SELECT term, count(*) AS qf FROM (SELECT explode(regexp_extract_all(lower(keyword_search.query), '[\\p{{L}}\\p{{N}}_]+', 0)) AS term) GROUP BY term),
            h AS (SELECT p.{key}, p.tf, p.dl, q.term, q.qf FROM keyword_postings p JOIN q ON p.term = q.term AND p.bucket = pmod(xxhash64(q.term), {R.BUCKETS})),
            f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
            s AS (SELECT h.{key}, sum(qf * ln((n_docs - df + 0.5D) / (df + 0.5D) + 1.0D) * tf * {R.K1 + 1}D / (tf + {R.K1}D * ({1 - R.B}D + {R.B}D * dl / avg_dl))) AS score FROM h JOIN f ON h.term = f.term CROSS JOIN keyword_size GROUP BY h.{key}),
            r AS (SELECT {key}, score, row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM s WHERE score > 0)
            SELECT {key}, score, rank FROM r WHERE rank <= keyword_search.n""")
    if vectors is not None:
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).createOrReplaceTempView("search_vectors")
        dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION vector_search(vector ARRAY<DOUBLE>, n INT) RETURNS TABLE (vec_id BIGINT, score DOUBLE, rank INT) RETURN
            WITH s AS (SELECT vec_id, round({dot('embedding', 'vector_search.vector')} / sqrt({dot('embedding', 'embedding')}) / sqrt({dot('vector_search.vector', 'vector_search.vector')}), 12) AS score FROM search_vectors WHERE size(embedding) = size(vector_search.vector) AND {dot('embedding', 'embedding')} > 0),
            r AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT vec_id, score, rank FROM r WHERE rank <= vector_search.n""")
