"""Whole pipelines made of the operators: ingestion, retrieval for a question, history, audits.

Word-hash vectors stand in for an embedding model; documents play the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import words as Wd
from skein.operators import chat, chunking, corpus
from skein.operators import retrieval as R
from skein.plans.registry import query, table
from skein.sources import scratch

EMBED = corpus.hashed_embedding(64)


def indexed(docs: DataFrame) -> DataFrame:
    """C1. Chunks of documents: split, checked, freed of near copies within a document, cleaned, embedded.

    They are written once, as the search for near copies reads them more than once.
    """
    parts = chunking.good_chunks(docs).withColumn("cleaned", X.clean(F.col("text")))
    embedded = scratch.written(corpus.through_model(parts, "cleaned", EMBED, "embedding", "array<double>"), "chunks")
    kept = corpus.near_copies(embedded.select("doc_id", "chunk_index", "embedding"), "doc_id", "chunk_index", "embedding")
    return embedded.join(kept, ["doc_id", "chunk_index"]).withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_index"))


def updated(index: DataFrame, now: DataFrame, history: DataFrame, docs: DataFrame) -> DataFrame:
    """C1, incremental: the chunks of unchanged files are carried forward, those of new and changed ones are made."""
    fresh = indexed(docs.join(corpus.changed_files(now, history).select("file_name"), "file_name", "left_semi")).withColumn("file_name", F.concat(F.lit("f"), "doc_id"))
    return corpus.kept_chunks(index, now, history).unionByName(fresh)


def hits(index: DataFrame, questions: DataFrame, n: int, over: int, threshold: float) -> DataFrame:
    """query_id, chunk_id, score, rank: the over-fetched best chunks of each question, then those above the threshold."""
    asked = corpus.through_model(questions.withColumn("text", X.spoken(F.substring("text", 1, 520))), "text", EMBED, "embedding", "array<double>")
    return scratch.written(R.relevant(R.nearest(index, asked, n * over, "chunk_id"), threshold), "hits")  # few rows: texts meet them where they are


def snippets(index: DataFrame, docs: DataFrame, top: DataFrame) -> DataFrame:
    """chunk_id, doc_id, chunk_index, snippet of the chunks that were hit: a chunk is widened once however many questions hit it, and a document's text moves once."""
    chunks = index.select("chunk_id", "doc_id", "chunk_index", "text", "char_start", "char_end").join(top.select("chunk_id").distinct(), "chunk_id", "left_semi")
    listed = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", "chunk_index", "text", "char_start", "char_end")).alias("_c"))
    found = listed.join(docs.select("doc_id", F.col("text").alias("full")), "doc_id").select("doc_id", "full", F.inline("_c"))
    return chunking.expanded(found).select("chunk_id", "doc_id", "chunk_index", X.spoken(F.col("expanded")).alias("snippet"))


def answered(index: DataFrame, docs: DataFrame, questions: DataFrame, n: int = 3, threshold: float = R.THRESHOLD) -> DataFrame:
    """C2. Documents with their best snippets, widened to their surroundings and made safe for speech."""
    top = hits(index, questions, n, 3, threshold)
    wide = top.select("query_id", "chunk_id", "score").join(snippets(index, docs, top), "chunk_id")
    ranked = wide.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_index")))
    top = ranked.where("_r <= 3").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    return R.best(top, n)


def enriched(index: DataFrame, docs: DataFrame, questions: DataFrame, k: int = 5, budget: int = 600, threshold: float = 0.2) -> DataFrame:
    """C3. Hybrid retrieval into one budgeted context with citations."""
    asked = corpus.through_model(questions, "text", EMBED, "embedding", "array<double>")
    semantic = R.nearest(index, asked, 2 * k, "chunk_id").withColumnRenamed("chunk_id", "id")
    # sums in another order differ in their last digits: rounded, equal texts tie and come by key on every run
    nine = lambda scored: scored.withColumn("score", F.round("score", 9))
    keyword = R.best(nine(R.bm25(index, questions, "chunk_id", n=2 * k)), 2 * k, "chunk_id").withColumnRenamed("chunk_id", "id")
    top = scratch.written(R.best(R.relevant(nine(R.fused(semantic, keyword)), threshold), k, "id"), "hits")
    rows = top.join(index.select(F.col("chunk_id").alias("id"), "doc_id", "text"), "id").withColumn("text", X.spoken(F.col("text")))
    return R.within_budget(rows, budget).withColumn("citation", F.format_string("[%d: document %d]", F.col("rank"), F.col("doc_id")))


def combined_context(found: DataFrame, budget: int) -> DataFrame:
    """W7. Documents (query_id, rank, source, snippets) into one text within a budget of tokens.

    A document's snippets end at the first that would overflow; the documents end with
    the first whose text reaches over the budget.
    """

    def run(rows):
        import pandas as pd

        out = ""
        for r in rows.sort_values("rank").itertuples(index=False):
            part = f"[Doc {r.rank}] {r.source}\n"
            for s in r.snippets:
                line = f"  • {s}\n"
                if len(out + part + line) // X.CHARS_PER_TOKEN > budget:
                    break
                part += line
            out += part + "\n"
            if len(out) // X.CHARS_PER_TOKEN > budget:
                break
        return pd.DataFrame({"query_id": rows["query_id"].iloc[:1], "context": [out]})

    return found.groupBy("query_id").applyInPandas(run, "query_id long, context string")


#: N4. Text transforms by name.
TRANSFORMS = {"clean": X.clean, "speech": X.spoken, "markdown": X.plain_markdown, "emoji": X.without_emoji, "turn": X.turn_text}


def transformed(df: DataFrame, column: str, *names: str) -> DataFrame:
    """N4. The named transforms in turn; an unknown name raises ValueError."""
    for n in names:
        if n not in TRANSFORMS:
            raise ValueError(f"no text transform is named {n}; there are {', '.join(TRANSFORMS)}")
        df = df.withColumn(column, TRANSFORMS[n](F.col(column)))
    return df


def questions(spark, d):
    """Every fifth benchmark text."""
    return table(spark, d, "benchmark").where("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), "text")


def small(spark, d):
    return table(spark, d, "documents")


def index_of(spark, d):
    """C1's index, written once and read by whatever asks it, so that chunks are embedded once."""
    return scratch.written(indexed(small(spark, d)), "index")


@query()
def c1_build_index(spark, d):
    return indexed(small(spark, d)).select("chunk_id", "doc_id", "chunk_index", F.size("embedding").alias("dim"))


@query()
def c2_answer_questions(spark, d):
    docs = small(spark, d)
    return answered(index_of(spark, d), docs, questions(spark, d), threshold=0.2).select("query_id", "doc_id", "rank", F.size("snippets").alias("snippets"))


@query()
def c3_enrich(spark, d):
    docs = small(spark, d)
    return enriched(index_of(spark, d), docs, questions(spark, d)).select("query_id", "rank", "citation", "truncated")


@query()
def w7_combined_context(spark, d):
    docs = small(spark, d)
    found = answered(index_of(spark, d), docs, questions(spark, d), threshold=0.2)
    return combined_context(found.withColumn("source", F.concat(F.lit("document "), "doc_id")), 300)


@query("""WITH l AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), x AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '2024-02-05') / 86400000000.0 AS days FROM l WHERE r <= 6),
y AS (SELECT *, CASE WHEN days < 1 THEN 'today' WHEN days < 2 THEN 'yesterday' WHEN days < 7 THEN floor(days)::BIGINT || ' days ago' WHEN days < 14 THEN 'more than a week ago' WHEN days < 30 THEN '2 weeks ago' ELSE 'more than a month ago' END AS label FROM x)
SELECT user_id, event_id, label, label IS DISTINCT FROM lag(label) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS heading FROM y""")
def c8_load_history(spark, d):
    """The last six messages of each user in order, with a heading where the relative day changes."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("_r <= 6")
    rows = last.withColumn("label", chat.relative_day(F.col("ts"), F.lit("2024-02-05").cast("timestamp")))
    return chat.headed(rows, "user_id", ["ts", "event_id"], "label").select("user_id", "event_id", "label", "heading")


THE = r"(^|[\t-\r ])the([!-/:-@\[-`{-~]*)($|[\t-\r ])"


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{THE}', '\1THAT\2\3', 'gi'), '{THE}', '\1THAT\2\3', 'gi')) AS digest FROM documents")
def t8_replaced_words(spark, d):
    """The SQL replaces twice, as neighbouring matches share a blank."""
    return small(spark, d).select("doc_id", F.md5(Wd.replaced_words(F.col("text"), {"the": "THAT"})).alias("digest"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS b, list_filter(regexp_split_to_array(regexp_replace(text, '[.,]', '', 'g'), '\s+'), lambda w: w <> '') AS a FROM conversations),
d AS (SELECT *, list_reduce(list_prepend(range(len(b) + 1)::BIGINT[], list_transform(range(1, len(a) + 1), lambda i: [i]::BIGINT[])), lambda row, i: list_reduce(list_prepend([row[1] + 1]::BIGINT[], list_transform(range(1, len(b) + 1), lambda j: [j]::BIGINT[])), lambda made, j: list_append(made, least(made[-1] + 1, row[j[1] + 1] + 1, row[j[1]] + CASE WHEN b[j[1]] <> a[i[1]] THEN 1 ELSE 0 END)))) AS last FROM t)
SELECT conv_id, turn, last[-1]::DOUBLE / greatest(len(b), 1) AS rate FROM d""")
def a25_word_error_rate(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("truth"), F.regexp_replace("text", "[.,]", "").alias("said"))
    return rows.select("conv_id", "turn", Wd.word_error_rate(F.col("said"), F.col("truth")).alias("rate"))


@query("SELECT conv_id, turn, md5(text || ' yes') AS digest FROM conversations")
def n4_named_transforms(spark, d):
    """Marks and an emoji are put around every text; it has to come back."""
    marked = table(spark, d, "conversations").withColumn("text", F.concat(F.lit("## "), "text", F.lit(" *yes* \U0001f600")))
    rows = transformed(marked, "text", "markdown", "emoji")
    return rows.select("conv_id", "turn", F.md5(X.strip(F.col("text"))).alias("digest"))


def pairs(spark, d):
    """Question-answer pairs from neighbouring user and assistant turns."""
    c = table(spark, d, "conversations")
    u, a = c.alias("u"), c.alias("a")
    near = (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1) & (F.col("u.role") == "user") & (F.col("a.role") == "assistant")
    return u.join(a, near).select("u.conv_id", "u.turn", F.col("u.text").alias("question"), F.col("a.text").alias("answer"))


def advanced(index: DataFrame, docs: DataFrame, variants: DataFrame, types: list[str], k: int = 5) -> DataFrame:
    """C4. The best score over a question's variants, documents of the given types only, widened, with token counts."""
    asked = corpus.through_model(variants, "text", EMBED, "embedding", "array<double>")
    allowed = index.join(docs.where(F.exists(F.array(*(F.lit(t) for t in types)), lambda t: F.endswith(F.col("source"), t))).select("doc_id"), "doc_id", "left_semi")
    top = scratch.written(R.best(R.variant_scores(allowed, asked, "chunk_id", k), k, "chunk_id"), "hits")
    rows = top.join(index.select("chunk_id", "doc_id", "text", "char_start", "char_end"), "chunk_id").join(docs.select("doc_id", F.col("text").alias("full")), "doc_id")
    return chunking.expanded(rows).withColumn("tokens", X.tokens(F.col("expanded")))


def answered_from_pairs(qa: DataFrame, asked: DataFrame, k: int = 3, threshold: float = R.THRESHOLD) -> DataFrame:
    """C5. The k nearest questions from the threshold on, with answers safe for speech."""
    base = scratch.written(corpus.through_model(qa.withColumn("id", F.concat_ws("-", "conv_id", "turn")), "question", EMBED, "embedding", "array<double>"), "pairs")
    q = corpus.through_model(asked, "text", EMBED, "embedding", "array<double>")
    top = scratch.written(R.relevant(R.nearest(base, q, k, "id"), threshold, inclusive=True), "hits")
    return top.join(base.select("id", "answer"), "id").withColumn("answer", X.spoken(F.col("answer")))


def made_pairs(docs: DataFrame, ask, target: int = 400) -> DataFrame:
    """C6. Sections of documents sent to a model that gives one question a section; pairs that break a rule go, then repeats.

    ``ask`` is a function from texts to questions; the section serves as the answer.
    """
    parts = chunking.section_chunks(docs, target=target, overlap=60).withColumn("language", X.language(F.col("text")))
    made = corpus.through_model(parts, "text", ask, "question", "string").withColumn("answer", F.col("text"))
    good = made.where(X.qa_verdict(F.col("question"), F.col("answer")).isNull()).withColumn("q", F.lower("question"))
    return chat.distinct_ignoring_case(good, "doc_id", "q", "chunk_num").drop("q")


def first_sentence(texts: list[str]) -> list[str]:
    """A stand-in for a language model: asks what the first sentence says."""
    return [f"What about {t.partition('.')[0].strip()}?" for t in texts]


def routed(messages: DataFrame, qa: DataFrame, index: DataFrame, docs: DataFrame, mode: str = "both") -> DataFrame:
    """C7. The last user message of each conversation, unless too short, answered from pairs, chunks or both."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text")).where(F.length(X.strip(F.col("text"))) >= 3)
    asked = last.select(F.col("conv_id").alias("query_id"), "text")
    found = []
    if mode in ("qa", "both"):
        found.append(answered_from_pairs(qa, asked, threshold=0.3).select("query_id", F.lit("qa").alias("kind"), F.col("id").alias("hit"), "score"))
    if mode in ("chunk", "both"):
        found.append(answered(index, docs, asked, threshold=0.3).select("query_id", F.lit("chunk").alias("kind"), F.col("doc_id").cast("string").alias("hit"), "score"))
    if not found:
        raise ValueError(f"mode must be qa, chunk or both, not {mode}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query()
def c4_advanced_search(spark, d):
    docs = small(spark, d)
    variants = questions(spark, d).withColumn("query_id", F.floor(F.col("query_id") / 20))  # four variants a question
    return advanced(index_of(spark, d), docs, variants, ["1", "3"]).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "tokens")


@query()
def c5_answer_from_pairs(spark, d):
    return answered_from_pairs(pairs(spark, d), questions(spark, d), threshold=0.3).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query()
def c6_make_pairs(spark, d):
    return made_pairs(small(spark, d), first_sentence).select("doc_id", "chunk_num", "language", "question")


@query()
def c7_route_messages(spark, d):
    docs = small(spark, d)
    return routed(table(spark, d, "conversations"), pairs(spark, d), index_of(spark, d), docs).select("query_id", "kind", "hit", F.round("score", 6).alias("score"))
