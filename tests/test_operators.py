from __future__ import annotations

import io
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import chat, corpus, retrieval, signals
from skein.sources import readers, sinks
from skein.streaming import streams


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def test_bm25_by_hand(spark):
    docs = {1: "a b b", 2: "a c", 3: "d", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(df, spark.createDataFrame([(0, "b a b x")], "query_id long, text string")).collect()}
    mean = 6 / 4

    def part(tf, df_, n):
        return np.log((4 - df_ + 0.5) / (df_ + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))

    assert got == pytest.approx({1: part(1, 2, 3) + 2 * part(2, 1, 3), 2: part(1, 2, 2)})


def test_fusion_of_disjoint_equal_and_empty_lists(spark):
    schema = "query_id long, id string, score double"
    a = spark.createDataFrame([(0, "x", 0.5), (0, "y", 0.5)], schema)
    b = spark.createDataFrame([(0, "z", 3.0), (0, "y", 1.0)], schema)
    assert rows(retrieval.fused(a, b)) == [(0, "x", 0.7), (0, "y", 0.7), (0, "z", 0.3)]
    assert rows(retrieval.fused(a.where("false"), b)) == [(0, "y", 0.0), (0, "z", 0.3)]


def test_budget_stops_at_the_first_overflow(spark):
    items = [(0, 1, "a" * 400), (0, 2, "b. " * 400), (0, 3, "c" * 4)]
    df = spark.createDataFrame(items, "query_id long, rank long, text string")
    got = rows(retrieval.within_budget(df, 350).select("rank", "truncated"))
    assert got == [(1, False), (2, True)]
    assert rows(retrieval.within_budget(df, 250).select("rank", "truncated")) == [(1, False)]


def test_near_copies_are_greedy(spark):
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    items = [("d", 1, at(0)), ("d", 2, at(15)), ("d", 3, at(30)), ("d", 4, None), ("d", 5, [0.0, 0.0]), ("d", 6, at(0)), ("e", 7, at(0))]
    df = spark.createDataFrame(items, "doc string, id long, v array<double>")
    assert rows(corpus.near_copies(df, "doc", "id", "v", 0.95)) == [("d", 1), ("d", 3), ("d", 4), ("d", 5), ("e", 7)]
    assert rows(corpus.near_copies(df, "doc", "id", "v", 0.95, block=1)) == [("d", 1), ("d", 3), ("d", 4), ("d", 5), ("e", 7)]


def test_upsert_keeps_the_name_only(spark):
    schema = "email string, site string, display_name string, status string, plan string, expires_at long"
    old = spark.createDataFrame([("A@x", "s", "Ann", "active", "pro", 5), ("b@x", "s", "Bo", "active", "pro", 5)], schema)
    new = spark.createDataFrame([("a@X", "s", None, "paid", None, None), ("c@x", "s", None, "paid", "pro", 1)], schema)
    assert rows(corpus.upserted(old, new)) == [("a@x", "s", "Ann", "paid", None, None), ("b@x", "s", "Bo", "active", "pro", 5), ("c@x", "s", None, "paid", "pro", 1)]


def test_edit_script_and_replay(spark):
    schema = "conv_id long, turn long, id string, text string"
    old = spark.createDataFrame([(1, i, x, x) for i, x in enumerate("abcd")], schema)
    new = spark.createDataFrame([(1, i, x[0], x) for i, x in enumerate(["a", "c!", "x", "d"])], schema)
    assert set(rows(chat.edit_script(old, new))) == {(1, "remove", "b", None), (1, "update", "c", "a"), (1, "create", "x", "c")}
    log = [(1, 1, "insert", "a", None), (1, 2, "insert", "b", "a"), (1, 3, "insert", "c", "a"), (1, 4, "delete", "b", None), (1, 5, "insert", "z", "nowhere"), (1, 6, "insert", "d", None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, action string, id string, previous_id string")
    assert rows(chat.replayed(df)) == [(1, 0, "d"), (1, 1, "a"), (1, 2, "c")]


def test_truncation_repeats_the_system_message(spark):
    chats = spark.createDataFrame([(1, 0, "user"), (1, 1, "tool"), (1, 2, "system"), (1, 3, "user")], "conv_id long, turn long, role string")
    assert rows(chat.truncated(chats, 3).select("position", "turn")) == [(-1, 2), (2, 2), (3, 3)]
    assert rows(chat.truncated(chats, 4).select("position", "turn")) == [(0, 0), (1, 1), (2, 2), (3, 3)]


SIGNAL = [(0.1, 0.9), (0.2, 0.1), (0.3, 0.9), (0.4, 0.9), (0.5, 0.1), (0.6, 0.1), (0.7, 0.9), (0.8, 0.1), (0.9, 0.1), (1.0, 0.1), (1.1, 0.9), (1.2, 0.9)]
EVENTS = [(1, 0.4, "start"), (1, 1.0, "end"), (1, 1.2, "start")]


def test_activity(spark):
    df = spark.createDataFrame([(1, t, p, 0.1) for t, p in SIGNAL], "key long, t double, p double, dt double")
    assert rows(signals.activity(df, least_on=0.2, least_off=0.3).select("key", "t", "event")) == EVENTS


def test_as_of(spark):
    known = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0)], "k long, ts long, v double")
    asked = spark.createDataFrame([(1, 5, 1), (1, 10, 2), (1, 25, 3), (2, 9, 4)], "k long, ts long, asked_id long")
    assert rows(signals.value_at(asked, known, "k", "ts", "v").select("asked_id", "value")) == [(1, None), (2, 1.0), (3, 2.0), (4, None)]


@pytest.mark.parametrize("size", [1, 3, 12])
def test_streams_equal_batches(spark, tmp_path, size):
    """The same events however the stream is cut into batches."""
    source = tmp_path / "in"
    schema = "key long, t double, p double, dt double"
    for i in range(0, len(SIGNAL), size):
        spark.createDataFrame([(1, t, p, 0.1) for t, p in SIGNAL[i : i + size]], schema).coalesce(1).write.mode("append").json(str(source))
    files = sorted(source.glob("*.json"), key=lambda f: f.stat().st_mtime_ns)
    for i, f in enumerate(files):
        __import__("os").utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = streams.activity(stream, least_on=0.2, least_off=0.3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("key", "t", "event")) == EVENTS


def test_text_streams(spark, tmp_path):
    data = [(1, 0, "Hello the"), (1, 1, "re, how are you to"), (1, 2, "day? Fine <thi"), (1, 3, "nk. And you"), (1, 4, None)]
    spark.createDataFrame(data, "key long, seq long, text string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key long, seq long, text string").json(str(tmp_path / "in"))
    got = {}

    def sink(df, _):
        got.setdefault("n", []).extend(tuple(r) for r in df.collect())

    assert streams.to_sinks(streams.sentence_stream(stream()), [sink], str(tmp_path / "c1")).awaitTermination(60)
    assert sorted(got["n"]) == [(1, 0, "Hello there, how are you today?"), (1, 1, "Fine <think. And you")]
    kinds = [(1, 0, "interim", "hel"), (1, 1, "final", "hello"), (1, 2, "interim", "wor"), (1, 3, "end", "")]
    spark.createDataFrame(kinds, "key long, seq long, kind string, text string").coalesce(1).write.json(str(tmp_path / "in2"))
    got.clear()
    s = spark.readStream.schema("key long, seq long, kind string, text string").json(str(tmp_path / "in2"))
    assert streams.to_sinks(streams.transcripts(s), [sink], str(tmp_path / "c2")).awaitTermination(60)
    assert got["n"] == [(1, 3, "hello wor")]


def test_windowed_streams(spark, tmp_path):
    stamps = [datetime(2024, 1, 1, 0, 0, s) for s in (1, 2, 3, 59)] + [datetime(2024, 1, 1, 0, 1, 0), datetime(2024, 1, 1, 1, 0, 0)]
    spark.createDataFrame([(7, t) for t in stamps], "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    got = []
    q = streams.rate_limited(stream, 3, late="1 minute")
    assert streams.to_sinks(q, [lambda df, _: got.extend(tuple(r) for r in df.select("user_id", "n").collect())], str(tmp_path / "c")).awaitTermination(60)
    assert got == [(7, 4)]
    batch = signals.over_limit(spark.read.parquet(str(tmp_path / "in")), 3)
    assert rows(batch.select("user_id", "n")) == [(7, 4)]


def test_sources_and_snapshots(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"plain \xff text")
    (folder / "b.bin").write_bytes(b"x")
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("one", " ", "two"))
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    (folder / "c.docx").write_bytes(buffer.getvalue())
    (folder / "d.docx").write_bytes(b"broken")
    found = {r["path"].rpartition("/")[2]: (r["text"], r["error"] is None) for r in readers.documents(spark, str(folder)).collect()}
    assert found == {"a.txt": ("plain  text", True), "b.bin": ("", True), "c.docx": ("one\n\ntwo", True), "d.docx": ("", False)}
    assert [r["text"] for r in readers.text_files(spark, str(folder)).collect()] == ["plain  text"]
    assert [r["stem"] for r in readers.listing(spark, str(folder), "*.txt").collect()] == ["a"]
    pages = spark.createDataFrame([("[Page 1]\nx\n[Page 2]\ny z",)], "t string").select(readers.pages_of(F.col("t")).alias("p")).first()["p"]
    assert [tuple(p) for p in pages] == [(1, "x"), (2, "y z")]
    path = str(tmp_path / "index")
    assert readers.snapshot(spark, path) is None
    sinks.publish(spark.range(3).toDF("id"), path)
    sinks.publish(spark.range(5).toDF("id"), path)
    (tmp_path / "index" / "v9").mkdir()
    assert readers.snapshot(spark, path).count() == 5
    sinks.append_report(spark.range(1), str(tmp_path / "report"))
    sinks.append_report(spark.range(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    (tmp_path / "qa.json").write_text('{"qa_pairs": [{"question": "q", "answer": "a"}, {"question": "", "answer": "a"}]}')
    assert rows(readers.qa_files(spark, str(tmp_path / "qa.json")).select("question", "context")) == [("q", "a")]


def test_every_nth_with_gaps_and_repeats(spark, tmp_path):
    from skein.plans.catalog import QUERIES

    ids = sorted([*range(-60, 100, 7), *range(4000, 9000, 3), *[4090] * 60, 50_000])
    spark.createDataFrame([(i, "a") for i in ids], "vec_id long, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r["vec_id"] for r in QUERIES["k8_every_nth"](spark, str(tmp_path)).collect()) == ids[::25]


def test_export_writes_whole_texts(spark, tmp_path):
    from skein.sources.sinks import write_export

    text = "first line " * 20 + "\nsecond \\n line\r\nend"
    write_export(spark.createDataFrame([(7, "s", text)], "doc_id long, source string, text string"), f"{tmp_path}/out")
    want = "s#000007: " + text.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == [want]


@pytest.mark.parametrize("n", [1, 2, 3, 1001, 30_000])
def test_ranks_are_exact(spark, n):
    """A hot group of many different values and ties, and a small one, against sorting."""
    rng = np.random.default_rng(n)
    hot = [("a", float(v)) for v in rng.normal(size=n)] + [("a", 0.5)] * (n // 3) + [("a", None)]
    small = [("b", 1.0), ("b", 4.0), ("c", None)]
    df = spark.createDataFrame(hot + small, "k string, v double")
    values = sorted(v for _, v in hot if v is not None)
    got = dict(map(tuple, signals.medians(df, "k", "v").collect()))
    assert got == pytest.approx({"a": float(np.median(values)), "b": 2.5})
    for p in (0.0, 0.95, 1.0):
        got = dict(map(tuple, signals.index_percentile(df, "k", "v", p, "x").collect()))
        assert got == {"a": values[min(int(len(values) * p), len(values) - 1)], "b": 4.0 if p else 1.0}


def test_edit_script_keeps_a_longest_common_subsequence(spark):
    """On shuffled versions: replaying the script gives the new one, and no longer part could be kept."""
    rng = np.random.default_rng(5)
    old, new = [], []
    for conv in range(20):
        a, b = (list(rng.permutation(12)[: rng.integers(0, 13)]) for _ in range(2))
        old += [(conv, i, str(x), "t") for i, x in enumerate(a)]
        new += [(conv, i, str(x), "t") for i, x in enumerate(b)]
    schema = "conv_id long, turn long, id string, text string"
    script = chat.edit_script(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    for conv in range(20):
        a, b = ([x for c, _, x, _ in rows_ if c == conv] for rows_ in (old, new))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        removed = [r["id"] for r in script if r["conv_id"] == conv and r["action"] == "remove"]
        made = {r["id"]: r["previous_id"] for r in script if r["conv_id"] == conv and r["action"] == "create"}
        kept = [x for x in a if x not in removed]
        assert kept == [x for x in b if x not in made] and len(kept) == best[-1, -1]
        assert all(previous == (b[b.index(x) - 1] if b.index(x) else None) for x, previous in made.items())


def test_normal_forms_for_turn_models(spark):
    from skein.functions import text as X

    got = spark.createDataFrame([("ＡＢＣ！ ﬁne",), (None,), ("it's O-K.",)], "t string").select(X.turn_text(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in got] == ["abc fine", None, "it's o-k"]


def test_distinct_elements_shuffle_only_repeated_keys(spark):
    from skein.plans import catalog

    out = catalog.QUERIES["a12_distinct_ignoring_case"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]  # of keys in several rows
    given = [(1, ["b", "A", None, "a", "B", None, "c"]), (2, ["x", "X"]), (2, ["y", "z", "x", "Y"]), (None, ["q", "Q"]), (None, ["w", "r", "q"]), (3, None), (4, []), (5, ["ß", "SS", "ẞ", "İ", "i"])]
    df = spark.createDataFrame(given, "k long, v array<string>")
    want = chat.distinct_ignoring_case(df.select("k", F.posexplode("v").alias("i", "w")), "k", "w", "i")
    got = chat.distinct_elements(df, "k", F.col("v"), "w", "i")
    assert got.columns == ["k", "i", "w"]
    key = lambda r: (str(r["k"]), str(r["w"]).lower(), r["i"])
    apart = lambda d: sorted((key(r) for r in d.collect() if r["k"] not in (2, None)))
    assert apart(got) == apart(want)
    assert sorted(key(r) for r in got.where("k = 2 or k is null").collect()) == [("2", "x", 0), ("2", "y", 0), ("2", "z", 1), ("None", "q", 0), ("None", "r", 1), ("None", "w", 0)]
