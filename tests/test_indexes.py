"""Written indexes, the memo, greedy removal and SQL's functions: against plain loops, and what they read."""

from __future__ import annotations

import math
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from skein.operators import chunking, corpus, keyword_index, sql_functions, vector_index
from skein.operators import retrieval as R
from skein.sources import segments

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def files_read(df) -> int:
    """The files that the scans of a plan opened, by Spark's own count."""
    rows = df._jdf.queryExecution().executedPlan()
    rows.execute().count()
    found, todo = 0, [rows]
    while todo:
        p = todo.pop()
        if p.metrics().contains("numFiles"):
            found += p.metrics().apply("numFiles").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
    return found


# keyword index


def slow_bm25(docs: dict, queries: dict) -> dict:
    terms = {k: re.findall(r"\w+", (t or "").lower()) for k, t in docs.items()}
    mean = sum(map(len, terms.values())) / len(terms)
    out = {}
    for q, text in queries.items():
        for k, own in terms.items():
            score = 0.0
            for w in re.findall(r"\w+", text.lower()):
                df = sum(w in o for o in terms.values())
                tf = own.count(w)
                score += math.log((len(terms) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean)) if tf else 0
            if score > 0:
                out[q, k] = round(score, 9)
    return out


def found(df) -> dict:
    return {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in df.collect()}


def test_keyword_index_follows_its_changes(spark, tmp_path):
    path = str(tmp_path)
    queries = {1: "the grain mill, the MILL", 2: "river", 3: "nothing here"}
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    add = lambda rows: keyword_index.add(spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit("clash")), path)
    drop = lambda *keys: keyword_index.delete(spark.createDataFrame([(k,) for k in keys], "doc_id long"), path)
    known: dict = {}

    def same():
        assert found(keyword_index.search(spark, path, asked)) == pytest.approx(slow_bm25(known, queries))
        n, mean = keyword_index.size(spark, path).collect()[0]
        assert (n, mean) == (len(known), sum(len(re.findall(r"\w+", t or "")) for t in known.values()) / len(known))
        assert {r["doc_id"] for r in keyword_index.documents(spark, path).collect()} == set(known)

    first = [(1, "the old mill by the river"), (2, "grain for the mill"), (3, None), (4, ""), (5, "river river river")]
    add([*first, (None, "mill")])
    known.update(first)
    add([(2, "grain came by the river"), (6, "the mill stands"), (3, "a mill")])  # two are replaced
    known.update({2: "grain came by the river", 6: "the mill stands", 3: "a mill"})
    same()
    drop(1, 99, 4)
    del known[1], known[4]
    same()
    add([(1, "mill again")])  # a deleted key comes back
    known[1] = "mill again"
    before, entries = segments.read(spark, path)
    assert len(entries) == 4
    keyword_index.merge(spark, path)
    same()
    assert segments.read(spark, path)[0] == before + 1 and len(segments.read(spark, path)[1]) == 1
    assert segments.forget(spark, path) == 4
    same()
    drop(*known)
    assert found(keyword_index.search(spark, path, asked)) == {} and keyword_index.size(spark, path).collect()[0][0] == 0
    with pytest.raises(ValueError, match="twice"):
        add([(7, "a"), (7, "b")])


def test_keyword_index_merges_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "MOST_SEGMENTS", 2)
    for i in range(3):
        keyword_index.add(spark.createDataFrame([(i, "mill")], DOCS), str(tmp_path))
    assert len(segments.read(spark, str(tmp_path))[1]) == 1
    assert found(keyword_index.search(spark, str(tmp_path), spark.createDataFrame([(1, "mill")], "query_id long, text string"))) == pytest.approx(slow_bm25(dict.fromkeys(range(3), "mill"), {1: "mill"}))


def test_keyword_search_reads_the_asked_buckets(spark, tmp_path):
    path = str(tmp_path)
    keyword_index.add(spark.read.parquet(f"{SMALL}/documents.parquet"), path)
    asked = spark.createDataFrame([(1, "river mill")], "query_id long, text string")
    wanted = keyword_index.asked_buckets(asked)
    assert len(wanted) == 2 and files_read(keyword_index.postings(spark, path, buckets=wanted)) <= len(list(Path(path).glob("segments/*/postings/bucket=4[25]/*.parquet")))
    rows = keyword_index.postings(spark, path).groupBy("term").agg(F.countDistinct("bucket").alias("n")).where("n > 1")
    assert rows.count() == 0


def test_empty_keyword_index(spark, tmp_path):
    path = str(tmp_path)
    keyword_index.add(spark.createDataFrame([], DOCS), path)
    asked = spark.createDataFrame([(1, "river")], "query_id long, text string")
    assert keyword_index.search(spark, path, asked).collect() == []
    keyword_index.add(spark.createDataFrame([(1, "...")], DOCS), path)
    assert keyword_index.search(spark, path, asked).collect() == [] and keyword_index.size(spark, path).collect()[0]["n_docs"] == 1


def test_segments_have_one_writer_a_version(spark, tmp_path):
    path = str(tmp_path)
    assert segments.read(spark, path) == (0, [])
    assert segments.commit(spark, path, 0, [{"segment": "a"}]) == 1
    with pytest.raises(segments.ConcurrentChange):
        segments.commit(spark, path, 0, [{"segment": "b"}])
    (tmp_path / "manifest" / "v2.claim").touch()  # a writer that died
    with pytest.raises(segments.ConcurrentChange):
        segments.commit(spark, path, 1, [])
    segments.release(spark, path)
    assert segments.commit(spark, path, 1, [{"segment": "é"}]) == 2
    assert segments.read(spark, path) == (2, [{"segment": "é"}])


def test_term_counts(spark):
    rows = [(1, "b a b B c"), (2, None), (3, "..."), (4, "x")]
    got = {(r["doc_id"], r["term"]): (r["tf"], r["dl"]) for r in R.postings(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, "a"): (1, 5), (1, "b"): (3, 5), (1, "c"): (1, 5), (4, "x"): (1, 1)}


# vector index


def clustered(n: int, dim: int, centres: int, seed: int, spread: float = 0.35):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    x = c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "centres"), [(2_000, 30), (16_000, 120)])
def test_vector_index(spark, tmp_path, n, centres):
    """Recall at two sizes, against the exact way; a query reads a part of the folders."""
    x = clustered(n, 24, centres, n)
    odd = [(-1, None), (-2, []), (-3, [0.0] * 24), (-4, [float("nan")] * 24), (-5, [1.0, 2.0]), (-6, [2.0, 4.1])]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    path = str(tmp_path / "i")
    about = vector_index.write(rows, path, leaf=n // 40)
    assert vector_index.described(spark, path) == about and about["leaves"] == 40 and about["probes"] < 20
    asked = rows.where("vec_id % 50 = 0 or vec_id < 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in R.nearest(rows, asked, 10).collect()}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in vector_index.search(spark, path, asked, 10).collect()}
    assert len(set(got) & set(exact)) >= 0.9 * len(exact) and all(got[k] == exact[k] for k in set(got) & set(exact))
    whole = vector_index.search(spark, path, asked, 10, about["leaves"])
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in whole.collect()} == exact
    assert {k for k in got if k[0] == -5} == {(-5, -5), (-5, -6)}
    one = rows.where("vec_id = 50").select(F.col("vec_id").alias("query_id"), "embedding")
    assert files_read(vector_index.candidates(spark, path, one)[1]) <= about["probes"] < len(list(Path(path).glob("leaves/*/*.parquet")))


def test_vector_index_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    about = vector_index.write(rows, str(tmp_path / "a"))
    assert about["n"] == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], rows.schema)
    vector_index.write(one, str(tmp_path / "b"))
    got = vector_index.search(spark, str(tmp_path / "b"), one.withColumnRenamed("vec_id", "query_id"), 5).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in got] == [(1, 1, 1)]


def test_blocks_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [1.0]), (6, [1e200, 1e200]), (7, [float("inf"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = R.nearest(v, v.where("vec_id in (1, 3, 5)").withColumnRenamed("vec_id", "query_id"), 10).collect()
    assert sorted((r["query_id"], r["vec_id"], round(r["score"], 6)) for r in got) == [(1, 1, 1.0), (1, 6, 0.707107), (5, 5, 1.0)]


def test_variants_of_a_query(spark):
    x = clustered(300, 8, 10, 1)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    asked = v.where("vec_id < 40").select((F.col("vec_id") % 3).alias("query_id"), "embedding")
    scores = np.round(x[:40] @ x.T, 12)
    best = {(q, i): scores[q::3, i].max() for q in range(3) for i in range(300)}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in R.variant_scores(v, asked).collect()}
    assert got == pytest.approx(best)
    top = R.best(R.variant_scores(v, asked, n=5), 5, "vec_id").collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in top) == sorted(k for q in range(3) for k in sorted((k for k in best if k[0] == q), key=lambda k: (-round(best[k], 12), k[1]))[:5])


# greedy removal


def slow_greedy(items, threshold, inclusive=False):
    kept = {}
    for g, k, v in sorted(items, key=lambda r: (str(r[0]), r[1])):
        own = kept.setdefault(g, [])
        x = None if v is None or not any(v) else np.array(v) / np.linalg.norm(v)
        near = [float(x @ y) for _, y in own if y is not None] if x is not None else []
        if not any(s >= threshold if inclusive else s > threshold for s in near):
            own.append((k, x))
    return sorted(((g, k) for g, own in kept.items() for k, _ in own), key=str)


def angles(of):
    return [[math.cos(a), math.sin(a)] for a in of]


@pytest.mark.parametrize(("front", "spread"), [(8, 16), (4096, 4096)])
def test_greedy_removal(spark, front, spread):
    """Chains, hubs, many alike, groups of one, unusable vectors; in one round and in many."""
    rng = np.random.default_rng(front)
    chain = angles(0.2 * i for i in range(31))  # each is near the next alone
    hub = angles([0.0] + [0.25 + 0.001 * i for i in range(60)] + [-0.3])
    rows = [("chain", i, v) for i, v in enumerate(chain)] + [("hub", i, v) for i, v in enumerate(hub)]
    rows += [("alike", i, v) for i, v in enumerate(angles(0.0001 * rng.random(200)))] + [("one", 1, [1.0, 0.0])]
    rows += [(None, i, v.tolist()) for i, v in enumerate(rng.standard_normal((150, 2)))]
    rows += [("odd", 1, None), ("odd", 2, [0.0, 0.0]), ("odd", 3, [1.0, 0.0]), ("odd", 4, [2.0, 0.0]), ("odd", 5, None)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>").withColumn("raw", F.lit("clash")).repartition(5)
    for inclusive in (False, True):
        got = sorted(((r["g"], r["k"]) for r in corpus.near_copies(df, "g", "k", "v", math.cos(0.21), inclusive, front, spread).collect()), key=str)
        assert got == slow_greedy(rows, math.cos(0.21), inclusive)
    assert corpus.near_copies(df.where("false"), "g", "k", "v").collect() == []


def test_one_hot_group_is_spread(spark):
    """A hundred thousand items of one group; no task compares more than its share of them."""
    n = 100_000
    a = F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") * (2 * math.pi / n))
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.array(F.cos(a), F.sin(a)).alias("v"))
    kept = sorted(r["k"] for r in corpus.near_copies(df, "g", "k", "v", math.cos(0.001)).collect())
    gaps = np.diff(np.array(kept[1:]) * (2 * math.pi / n))
    assert kept[0] == 0 and len(kept) == pytest.approx(2 * math.pi / 0.001, rel=0.06) and gaps.min() >= 0.001 - 1e-9


# memo


def test_memo_sends_each_text_once(spark, tmp_path):
    path, log = str(tmp_path / "m"), str(tmp_path / "log")

    def model(texts: list[str]) -> list:
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [None if t == "bad" else [float(len(t))] for t in texts]

    run = lambda rows: {r["id"]: r["e"] for r in corpus.memoised(spark.createDataFrame(rows, "id long, t string").repartition(4), "t", model, "e", "array<double>", path, "m1").collect()}
    first = [(i, f"text {i % 7}") for i in range(50)] + [(98, None), (99, "bad")]
    assert run(first) == {i: None if t in (None, "bad") else [float(len(t))] for i, t in first}
    second = [(i, f"text {i % 9}") for i in range(50)]
    assert run(second) == {i: [float(len(t))] for i, t in second}
    corpus.compact_memo(spark, path, "array<double>")
    assert run(second) == {i: [float(len(t))] for i, t in second}
    sent = [t for t in Path(log).read_text().splitlines() if t != "bad"]
    assert sorted(sent) == sorted(f"text {i}" for i in range(9))
    assert corpus.memo(spark, path, "array<double>").count() == 9
    assert {r["e"] for r in corpus.memoised(spark.createDataFrame([(1, "text 1")], "id long, t string"), "t", lambda ts: [1] * len(ts), "e", "long", str(tmp_path / "n"), "m2").collect()} == {1}


# SQL


def test_sql_functions_equal_the_dataframe_forms(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 40")
    sql_functions.register(spark, docs)
    docs.createOrReplaceTempView("some_docs")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(spark.sql("SELECT doc_id, c.* FROM some_docs, LATERAL text_chunks(text) c")) == rows(chunking.chunks(docs))
    sections = chunking.section_chunks(docs, target=100, overlap=20).select("doc_id", "chunk_num", "total_chunks", "first", "last", "tokens", "text")
    assert rows(spark.sql("SELECT doc_id, c.* FROM some_docs, LATERAL section_chunks(text, 100, 20) c")) == rows(sections)
    assert rows(spark.sql("SELECT * FROM rule_sentences")) == rows(docs.select("doc_id", F.posexplode(chunking.rule_sentences(F.col("text")))))


def test_sql_search_equals_the_dataframe_forms(spark, tmp_path):
    path = str(tmp_path)
    keyword_index.add(spark.read.parquet(f"{SMALL}/documents.parquet"), path)
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    sql_functions.register_search(spark, path, vectors)
    asked = spark.createDataFrame([(1, "water and the river")], "query_id long, text string")
    top = R.best(keyword_index.search(spark, path, asked), 10).orderBy("rank").collect()
    got = spark.sql("SELECT * FROM keyword_search('water and the river', 10) ORDER BY rank").collect()
    assert [(r["doc_id"], round(r["score"], 9)) for r in got] == [(r["doc_id"], round(r["score"], 9)) for r in top] != []
    one = vectors.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    near = R.nearest(vectors, one, 5).orderBy("rank").collect()
    got = spark.sql("SELECT s.* FROM vector_search((SELECT first(embedding) FROM search_vectors WHERE vec_id = 7), 5) s ORDER BY rank").collect()
    assert [(r["vec_id"], round(r["score"], 9)) for r in got] == [(r["vec_id"], round(r["score"], 9)) for r in near]


def test_best_of_each_source(spark):
    """Of many above the threshold, three a query and source; null sources are one, and blocks meet in the end."""
    x = clustered(5_000, 8, 6, 2)
    rows = [(i, None if i % 11 == 0 else i % 4, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").repartition(3)
    asked = v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    scores = np.round(x[:5] @ x.T, 12)
    known = set()
    for q in range(5):
        for s in (None, 0, 1, 2, 3):
            own = [(-scores[q, i], i) for i, label, _ in rows if label == s and scores[q, i] > 0.9]
            known |= {(q, s, i) for _, i in sorted(own)[:3]}
    got = R.best_by_source(v, asked, 3, 0.9, "label")
    assert {(r["query_id"], r["source"], r["vec_id"]) for r in got.collect()} == known and got.count() == len(known)


def test_variants_of_themselves_come_in_order_of_their_last_digits(spark):
    rows = [(i, np.random.default_rng(i).normal(size=24).astype(np.float32).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = v.where("vec_id % 5 = 0").selectExpr("0 as query_id", "vec_id as variant", "embedding")
    got = [(r["vec_id"], r["score"]) for r in R.variant_top(v, asked, 7).orderBy("rank").collect()]

    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        return s

    score = lambda q, x: dot(q, x) / math.sqrt(dot(q, q)) / math.sqrt(dot(x, x))
    want = sorted(((-max(score(q, x) for j, q in rows if j % 5 == 0), i) for i, x in rows))[:7]
    assert got == [(i, -s) for s, i in want]
    assert len({s for _, s in got}) > 1 or [i for i, _ in got] != list(range(0, 35, 5))


def test_chunks_of_an_index_are_embedded_once(spark, tmp_path, monkeypatch):
    from skein.plans import composite

    log = str(tmp_path / "sent")

    def embed(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [[1.0, float(len(t))] for t in texts]

    monkeypatch.setattr(composite, "EMBED", embed)
    docs = spark.createDataFrame([(i, f"This is the sentence with number {'x' * i} of a small text.") for i in range(20)], DOCS).coalesce(1)
    assert len(composite.indexed(docs).collect()) == 20
    assert sum(map(int, Path(log).read_text().split())) == 20


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    from skein.functions import arrays as A

    texts = ["a" * 10_000, "b" * 50_000, None, *("c" * 500 for _ in range(300))]
    found = list(A.pieces([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], 20_000))
    assert [t for b in found for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(0).to_pylist()) <= 20_000 for b in found)
    assert len(found) > 8


def test_texts_are_read_once_for_a_segment(spark, tmp_path):
    log = str(tmp_path / "read")

    def run(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write(f"{batch.num_rows}\n")
            yield batch

    docs = spark.createDataFrame([(i, f"a word {i} word"[: i + 1]) for i in range(15)] + [(15, None)], DOCS).mapInArrow(run, DOCS)
    keyword_index.add(docs, str(tmp_path / "index"))
    assert sum(map(int, Path(log).read_text().split())) == 16
    got = {(r["doc_id"], r["term"], r["tf"], r["dl"]) for r in keyword_index.postings(spark, str(tmp_path / "index")).collect()}
    assert {(14, "word", 2, 4), (14, "14", 1, 4), (0, "a", 1, 1)} <= got
    assert keyword_index.documents(spark, str(tmp_path / "index")).count() == 16


def test_queries_of_many_partitions_meet_vectors_in_full_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding").repartition(30)
    pairs = R._block_pairs(vectors, asked, "vec_id").select(F.size("qs").alias("q"), F.size("vs").alias("v")).collect()
    assert {r["q"] for r in pairs} == {100} and sum(r["v"] for r in pairs) == 300
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: np.argsort(-(x[q] @ x.T), kind="stable")[:5].tolist() for q in range(0, 300, 3)}
    got: dict = {}
    for r in R.nearest(vectors, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(100)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    assert R._block_pairs(vectors, asked, "vec_id").groupBy("vs").agg(F.sum(F.size("qs")).alias("n")).where("n <> 100").count() == 0
    top = R.nearest(vectors, asked, 1).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in top) == [(i, i) for i in range(100)]


def test_a_block_gives_n_of_many_alike(spark):
    same = spark.createDataFrame([(f"k{i:04}", [1.0, 2.0]) for i in range(500, 0, -1)], "vec_id string, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    got = R.block_scores(same, asked, R.first_n(3)).collect()
    assert sorted(r["vec_id"] for r in got) == ["k0001", "k0002", "k0003"]


def test_scores_of_a_document_are_summed_where_it_lies(spark):
    docs = spark.createDataFrame([(i, f"red w{i} {'blue ' * (i % 3)}") for i in range(60)], DOCS).repartition(6)
    asked = spark.createDataFrame([(q, "red blue") for q in range(9)], "query_id long, text string")
    scored = R.bm25(docs, asked)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(doc_id" in plan
    want = slow_bm25({i: f"red w{i} {'blue ' * (i % 3)}" for i in range(60)}, {q: "red blue" for q in range(9)})
    assert {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in scored.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_model_results_stay_in_arrow(spark):
    """Each text once, nulls stay, and a model that gives too few results is an error."""
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i % 7}") for i in range(70)], "id long, text string").coalesce(1)
    got = corpus.through_model(rows, "text", lambda ts: [[float(len(t))] if t != "t3" else None for t in ts], "v", "array<double>").collect()
    assert all(r["v"] == (None if r["text"] in (None, "t3") else [2.0]) for r in got) and len(got) == 70
    with pytest.raises(Exception, match="results for"):
        corpus.through_model(rows, "text", lambda ts: [], "v", "array<double>").collect()


def test_items_of_greedy_removal_are_made_once(spark, tmp_path):
    from skein.functions import arrays as A

    odd = [[1.0, 0.0], None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [0.0, 2.0], [2.0, 0.0]]
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(odd)], "g long, k long, v array<double>").coalesce(1).mapInArrow(run, "g long, k long, v array<double>")
    got = sorted(r["k"] for r in corpus.near_copies(rows, "g", "k", "v").collect())
    assert got == [0, 1, 2, 3, 4, 5, 6, 7] and seen.value == len(odd)
    sliced = __import__("pyarrow").array(odd).slice(3)
    assert A.spread(sliced)[3].tolist() == [False, False, False, False, True, True]


def test_reading_all_leaves_deals_no_query_to_each(spark, tmp_path, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(400, 8, 12, 5))] + [(1000, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = str(tmp_path / "index")
    about = vector_index.write(vectors, path, leaf=20)
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(vector_index, "_with_leaves", None)
    got = vector_index.search(spark, path, asked, 5, about["leaves"])
    want = R.nearest(vectors, asked, 5)
    pick = lambda d: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in d.collect())
    assert pick(got) == pick(want)


def test_sums_that_differ_in_their_last_digits_come_by_key(spark, monkeypatch):
    from skein.plans import composite

    index = spark.createDataFrame([(i, f"{i}#0", "red blue green", composite.EMBED(["red blue green"])[0]) for i in range(6)], "doc_id long, chunk_id string, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "red blue green")], "query_id long, text string")
    noisy = index.select(F.lit(1).cast("long").alias("query_id"), "chunk_id", (1 + F.col("doc_id") * 1e-15 * 5).alias("score"))
    monkeypatch.setattr(R, "bm25", lambda *a, **k: noisy)
    got = composite.enriched(index, index, asked, k=3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [0, 1, 2]


def test_messages_of_every_conversation_are_routed(spark, tmp_path):
    from skein.plans import composite

    text = "The old mill stands beside the river and grinds the grain of many farms every autumn. " * 3
    spark.createDataFrame([(1, text), (2, text.replace("mill", "forge"))], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"What of the mill and the grain of farm {c}?") for c in (3, 49, 50, 51) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = composite.c7_route_messages(spark, str(tmp_path)).select("query_id", "kind").distinct().collect()
    assert sorted(map(tuple, got)) == sorted((c, k) for c in (3, 49, 50, 51) for k in ("chunk", "qa"))


def test_nearest_in_many_blocks_keeps_ties_by_key_and_gives_few_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, size=(600, 3)).astype(float)  # many equal directions
    rows = [(f"k{i:03}", v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows[:40])], "query_id long, embedding array<double>")
    usable = [(k, np.array(v) / np.linalg.norm(v)) for k, v in rows if any(v)]
    want = set()
    for q, (_, v) in enumerate(rows[:40]):
        if any(v):
            order = sorted(usable, key=lambda u: (-round(float(u[1] @ np.array(v)) / float(np.linalg.norm(v)), 9), u[0]))  # noqa: B023
            want |= {(q, rank, u[0]) for rank, u in enumerate(order[:5], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in R.nearest(vectors, asked, 5).collect()} == want
    x, y = rng.normal(size=(20, 8)), rng.normal(size=(4000, 8))
    x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    top, given = np.full((20, 5), -np.inf), 0
    for a in range(0, 4000, 40):
        given += len(R.risen(x, y[a : a + 40], top)[0])
    assert np.allclose(top, np.sort(x @ y.T, axis=1)[:, -5:]) and given < 20 * 5 * 20  # 100 blocks


def test_centroids_are_fitted_in_tasks(spark):
    """The driver gets a row for each leaf, not the sample, and the rows' places change nothing."""
    x = clustered(900, 6, 10, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 2.0])], "vec_id long, v array<double>")
    made = []
    for parts in (1, 7):
        sample = vector_index._sampled(rows.repartition(parts), 901, 901).where(F.length("raw") > 16)
        assert sample.count() == 900
        made.append(vector_index.centroids_of(sample, 901, 10))
        sums = vector_index._leaf_sums(sample, made[-1]).collect()
        assert len(sums) <= 10 and len({r["leaf"] for r in sums}) == len(sums)
    assert np.array_equal(*made) and made[0].shape == (10, x.shape[1])
    assert np.allclose(np.linalg.norm(made[0], axis=1), 1)
    few = vector_index._sampled(rows, 901, 300).count()
    assert 200 < few < 400


def test_best_of_bm25_are_found_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 32)
    monkeypatch.setattr(R, "COLUMNS", 4)
    texts = [None if i == 7 else f"red w{i % 9} {'blue ' * (i % 3)} {'Green_1' if i % 50 == 0 else ''}" for i in range(400)]
    docs = spark.createDataFrame([(f"k{(i * 37) % 400:03}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame([(q, f"Red red w{q} blue green_1 none") for q in range(9)] + [(20, None), (21, "none")], "query_id long, text string")
    nine = lambda d: R.best(d.withColumn("score", F.round("score", 9)), 10, "chunk_id").select("query_id", "rank", "chunk_id", "score")
    got = R.bm25(docs, asked, "chunk_id", n=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and got.count() < 9 * 400 / 2
    assert sorted(map(tuple, nine(got).collect())) == sorted(map(tuple, nine(R.bm25(docs, asked, "chunk_id")).collect()))
    assert R.bm25(docs, asked.where("query_id >= 20"), "chunk_id", n=10).count() == 0
    monkeypatch.setattr(R, "MOST_ASKED", 2)
    assert R.bm25(docs, asked, "chunk_id", n=10).count() == 9 * 399
