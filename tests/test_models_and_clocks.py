"""Hyphenation, learned sentences, paced text and pinned snapshots."""

from __future__ import annotations

import json
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import hyphenation, sentence_model
from skein.sources import sinks
from skein.streaming import pacing, pinned

# T7


def slow_pieces(word: str, patterns: dict, exceptions: dict) -> list[str]:
    if len(word) <= 4:
        return [word]
    low = word.lower()
    if low in exceptions:
        at = exceptions[low]
    else:
        work, gap = f".{low}.", {}
        for letters, weights in patterns.items():
            for i in range(len(work)):
                if work.startswith(letters, i):
                    for j, w in enumerate(weights):
                        gap[i + j - 1] = max(gap.get(i + j - 1, 0), w)
        at = [p for p, w in gap.items() if w % 2]
    cuts = [0, *sorted(p for p in at if 2 <= p <= len(word) - 2), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def test_hyphenation(spark):
    given = ["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n", ".un1", "4ly.", "1ly", "a1a", "zz9z"]
    patterns = {re.sub("[0-9]", "", p): [int(x or 0) for x in re.split("[^0-9]", p)] for p in given}
    exceptions = {"table": [2], "present": [], "associate": [2, 4, 6]}
    words = ["hyphenation", "Hyphenation", "nation", "UNLIKELY", "unly", "table", "Tables", "present", "associate", "aaaaaaaa", "a", "", "übernation", "zzzzzz", "nation", None]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    pats = spark.createDataFrame([(p,) for p in given], "pattern string")
    excs = spark.createDataFrame([("ta-ble",), ("present",), ("as-so-ci-ate",)], "word string")
    got = {r["word"]: r["pieces"] for r in hyphenation.hyphenated(df, pats, excs).collect()}
    assert got == {w: slow_pieces(w, patterns, exceptions) for w in words if w is not None}
    assert got["hyphenation"] == ["hy", "phen", "ation"] and got["Tables"] == ["Tables"]
    assert {r["word"]: r["pieces"] for r in hyphenation.hyphenated(df, pats.where("false")).collect()}["nation"] == ["nation"]
    assert hyphenation.hyphenated(df.where("false"), pats).collect() == []


def test_hyphenation_reads_words_once_and_shuffles_nothing_else(spark, tmp_path):
    log = str(tmp_path / "read")

    def run(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write(f"{batch.num_rows}\n")
            yield batch

    df = spark.createDataFrame([(f"{w}ation",) for w in ("hyphen", "n", "st", "Rel", "x" * 300)], "word string").mapInArrow(run, "word string")
    out = hyphenation.hyphenated(df, spark.createDataFrame([("1na",), ("2st",), ("x1x",)], "pattern string"))
    assert {len(r["pieces"]) for r in out.collect()} == {1, 2, 299}
    assert sum(map(int, Path(log).read_text().split())) == 5
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


# T2

PLANTED = [
    "Dr. Miller came to the old house on the hill. The dog of Dr. Weber slept near the door.", "We bought apples, pears etc. at the market. The price was ca. 5 coins for approx. 20 apples.",
    "He met Dr. Lang at the station. The train was late approx. 10 minutes.", "It costs ca. 9 coins a day. The house of Dr. Stone is old.", "Bread, milk etc. are on the table. We eat at noon! Do we? The sun is high.",
    "The house is approx. 3 hours away. It rained ca. two days.", "My friend J. Smith wrote it. The letter came on the 3. may this year.",
]
KNOWN = [
    ["Dr. Miller came to the old house on the hill.", "The dog of Dr. Weber slept near the door."], ["We bought apples, pears etc. at the market.", "The price was ca. 5 coins for approx. 20 apples."],
    ["He met Dr. Lang at the station.", "The train was late approx. 10 minutes."], ["It costs ca. 9 coins a day.", "The house of Dr. Stone is old."], ["Bread, milk etc. are on the table.", "We eat at noon!", "Do we?", "The sun is high."],
    ["The house is approx. 3 hours away.", "It rained ca. two days."], ["My friend J. Smith wrote it.", "The letter came on the 3. may this year."],
]


def test_learned_sentences(spark):
    """Better than plain splitting on planted abbreviations, and the same on every run and partitioning."""
    plain = "Each day the door on the hill stands open at noon and days away from the table, high in the year that the market held, late for the minutes and the coins, and hours and apples are old near it"
    rows = [(i, t) for i, t in enumerate(PLANTED * 40)] + [(1000 + i, plain) for i in range(40)] + [(9000, None), (9001, ""), (9002, "..."), (9003, "no end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    model = sentence_model.fit(df)
    assert {"dr", "etc", "ca", "approx"} <= set(model.abbreviations) and not {"hill", "door", "day", "old", "noon"} & set(model.abbreviations)
    assert "the" in model.starters
    assert sentence_model.fit(df.coalesce(2)) == model
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", sentence_model.sentences(F.col("text"), model).alias("s")).collect()}
    plain = {r["doc_id"]: r["s"] for r in df.select("doc_id", X.sentences(F.col("text")).alias("s")).collect()}
    assert [got[i] for i in range(7)] == KNOWN
    assert sum(plain[i] == KNOWN[i] for i in range(7)) < 2
    assert got[9000] == got[9001] == [] and got[9002] == ["..."] and got[9003] == ["no end"]
    nothing = sentence_model.fit(df.where("false"))
    assert nothing == sentence_model.Model([], [], [])
    assert spark.createDataFrame([("An ant. C dee.",)], "t string").select(sentence_model.sentences(F.col("t"), nothing)).collect()[0][0] == ["An ant.", "C dee."]


# X12


def test_paced_text(spark):
    s, a = (lambda t, x: ("k", t, x, None)), (lambda t, x: ("k", t, None, x))
    rows = [s(0.0, "one"), s(0.1, "two"), s(0.2, "x" * 200), s(0.3, "y" * 150), s(0.4, "z"), a(1.0, 8.0), a(1.1, 0.5), a(20.0, 1.0), s(30.0, "late"), s(31.0, "never")]
    df = spark.createDataFrame(rows, "key string, t double, text string, seconds double")
    got = sorted((r["t"], r["text"]) for r in pacing.paced(df).collect())
    # the first at once; 8.5 s of sound from 1.0 leave five at 4.5: three sentences make 353 characters; sound at 20 lets the next go when it is quiet
    assert got == [(0.0, "one"), (4.5, "two " + "x" * 200 + " " + "y" * 150), (20.2, "z")]
    assert pacing.paced(df.where("seconds is not null")).collect() == []


ROWS = "key string, t double, text string, seconds double"


def test_paced_stream(spark, tmp_path):
    """The stream's timers give the rows that the fold gives, and a key's state ends after its time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()

    def put(name: str, rows: list) -> None:
        (tmp_path / name).write_text("".join(json.dumps(dict(zip(("key", "t", "text", "seconds"), r))) + "\n" for r in rows))
        (tmp_path / name).rename(tmp_path / "in" / name)

    try:
        stream = pacing.paced(spark.readStream.schema(ROWS).json(str(tmp_path / "in")), idle=15.0)
        query = stream.writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
        now = round(time.time(), 3)
        first = [("a", now, "one", None), ("a", now + 0.01, "two", None), ("a", now + 0.02, None, 0.5), ("b", now, "alone", None)]
        put("1", first)
        rows = lambda: sorted(tuple(r) for r in spark.table("paced").collect())
        until = time.time() + 60
        while len(rows()) < 3 and time.time() < until:
            time.sleep(0.5)
        known = sorted(tuple(r) for r in pacing.paced(spark.createDataFrame(first, ROWS)).collect())
        assert rows() == known and [r[2] for r in known] == ["one", "two", "alone"]
        time.sleep(17)  # longer than a state stays
        put("2", [("b", round(time.time(), 3), "again", None)])  # without sound it would wait, had the state stayed
        until = time.time() + 60
        while len(rows()) < 4 and time.time() < until:
            time.sleep(0.5)
        assert [r[2] for r in rows() if r[0] == "b"] == ["alone", "again"]
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# X11


def test_pinned_snapshots_in_a_stream(spark, tmp_path):
    """Versions are published between batches; a batch that fails reads its version again after a restart."""
    path, pins, source = (str(tmp_path / x) for x in ("snapshots", "pins", "in"))
    (tmp_path / "in").mkdir()
    seen, broken = [], [False]

    def work(batch, known, n):
        seen.append((n, sorted(r[0] for r in batch.collect()), None if known is None else known.collect()[0][0]))
        if broken[0]:
            raise RuntimeError("planted")

    def run(name: str | None):
        if name:
            (tmp_path / "in" / name).write_text(name + "\n")
        stream = spark.readStream.text(source)
        q = stream.writeStream.foreachBatch(pinned.with_newest(path, pins, work)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run("one")
    sinks.publish(spark.createDataFrame([("v1",)], "v string"), path)
    run("two")
    broken[0] = True
    with pytest.raises(Exception, match="planted"):
        run("three")
    sinks.publish(spark.createDataFrame([("v2",)], "v string"), path)
    broken[0] = False
    run(None)
    run("four")
    assert seen == [(0, ["one"], None), (1, ["two"], "v1"), (2, ["three"], "v1"), (2, ["three"], "v1"), (3, ["four"], "v2")]
    assert len(list((tmp_path / "pins").glob("batch-*"))) == 2


def test_tokens_are_counted_before_they_are_looked_at(spark):
    text = "Dr. Who met (Mr. X.) in a big-town. Then 3.5 went, e.g. home."
    one = sentence_model.tokens(spark.createDataFrame([(text,)], "text string"))
    many = sentence_model.tokens(spark.createDataFrame([(text,)] * 50, "text string").repartition(4))
    rows = lambda df, n: sorted((str(r["word"]), r["stop"], str(r["next"]), r["capital"], r["n"] // n) for r in df.collect())
    assert rows(many, 50) == rows(one, 1)
    assert ("dr", True, "who", True, 1) in rows(one, 1) and ("big-town", True, "then", True, 1) in rows(one, 1)


def test_a_large_model_is_looked_up_in_sets(spark):
    """A word is not compared with all of a model's, and is taken from its piece once."""
    model = sentence_model.Model([f"abb{i}" for i in range(500)] + ["dr"], ["the", *(f"s{i}" for i in range(500))], ["no one", *(f"a{i} b{i}" for i in range(500))])
    df = spark.createDataFrame([("Dr. Who met Dr. The end. See no. One left. At 3. may. At 3. May. I. Q. X ",)], "t string")
    out = df.select(sentence_model.sentences(F.col("t"), model).alias("s"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and plan.count("INSET") >= 4
    assert out.collect()[0][0] == ["Dr. Who met Dr.", "The end.", "See no. One left.", "At 3. may.", "At 3.", "May.", "I. Q. X"]
