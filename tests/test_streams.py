"""Stream, speech and history operators on small fixtures."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import history, speech
from skein.sources import readers, sinks
from skein.streaming import streams

MARKED = "# One *two*\n\n- see [a b](c d) and ![pic e](f)\n+ `x y` snake_case_name, __init__ it\n> **so be it** 3 * 4 and 2 + 2 - 1\n~~gone for good~~ ~~ stays ~~\n```python\ny = _a_ * b\n```\nlast _line is_ **open"
THINKING = "ab<think>no < no</thin no</think>c<thinker<thinkd<think>x</think><th"


def pieces(spark, text, size):
    rows = [(1, i, text[a : a + size]) for i, a in enumerate(range(0, len(text), size))]
    return spark.createDataFrame([*rows, (1, len(rows), None)], "key long, seq long, text string")


def whole(df, order):
    return "".join(r["text"] for r in df.orderBy(order).collect())


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_markdown_in_pieces(spark, size):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(MARKED.split("\n"))], "i long, text string")
    want = "\n".join(r["t"] for r in lines.select("i", X.plain_markdown(F.col("text")).alias("t")).orderBy("i").collect())
    assert whole(streams.markdown_stream(pieces(spark, MARKED, size)), "position") == want
    assert want.startswith("One two\n\nsee a b and pic e\nx y snake_case_name, init it\nso be it 3 * 4")


def test_markdown_gives_text_before_its_end(spark):
    rows = [(1, 0, "- some words **and more")]
    got = streams.markdown_stream(spark.createDataFrame(rows, "key long, seq long, text string"))
    assert whole(got, "position") == "some words"


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1000])
def test_thoughts_in_pieces(spark, size):
    assert whole(streams.without_thoughts(pieces(spark, THINKING, size)), "seq") == "abc<thinker<thinkd<th"


def test_folds_hold_their_state_between_batches(spark, tmp_path):
    for n, (text, fold, order, want) in enumerate(((MARKED, streams.markdown_stream, "position", None), (THINKING, streams.without_thoughts, "seq", "abc<thinker<thinkd<th"))):
        data = pieces(spark, text, 9)
        folder = tmp_path / f"in{n}"
        for r in data.collect():
            spark.createDataFrame([r], data.schema).coalesce(1).write.mode("append").parquet(str(folder))
        files = sorted(folder.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        for i, f in enumerate(files):
            __import__("os").utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 5).parquet(str(folder))
        got = []
        q = streams.to_sinks(fold(stream), [lambda df, _, got=got: got.extend(df.collect())], str(tmp_path / f"c{n}"))
        assert q.awaitTermination(90)
        text = "".join(r["text"] for r in sorted(got, key=lambda r: r[order]))
        assert text == (want or whole(fold(data), order))


def test_files_settle_and_snapshots_are_upserted(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("a", at + timedelta(seconds=s)) for s in (0, 30, 80, 200)] + [("b", at)]
    found = streams.settled_files(spark.createDataFrame(rows, "path string, ts timestamp")).orderBy("path", "last").collect()
    assert [(r["path"], r["changes"]) for r in found] == [("a", 3), ("a", 1), ("b", 1)]
    path = str(tmp_path / "table")
    sink = streams.upsert_into(path, "id")
    for n, batch in enumerate(([(1, "x"), (2, "y")], [(2, "z"), (3, "w"), (3, "w")], [(2, "z"), (3, "w"), (3, "w")])):
        sink(spark.createDataFrame(batch, "id long, v string"), n)
    assert sorted(map(tuple, readers.snapshot(spark, path).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_a_claimed_version_is_not_written_twice(spark, tmp_path):
    path = tmp_path / "index"
    path.mkdir()
    (path / "_v1.claim").touch()
    assert sinks.publish(spark.range(2), str(path)).endswith("/v2")
    assert readers.snapshot(spark, str(path)).count() == 2


def flux(x, rate):
    """The definition, one frame and one frequency at a time."""
    n = int(rate * 0.025)
    shape = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    scale = np.sqrt(sum(s * s for s in shape))
    spectra = []
    for a in range(0, len(x) - n + 1, n // 2):
        spectra.append([abs(sum(x[a + i] * shape[i] * np.exp(-2j * np.pi * f * i / n) for i in range(n))) / scale for f in range(n // 2 + 1)])
    changes = [sum(abs(p - q) for p, q in zip(a, b, strict=True)) for a, b in zip(spectra, spectra[1:], strict=False)]
    return sum(changes) / len(changes)


def test_speaking_rates_against_the_definition(spark):
    rate = 400
    sound = np.random.default_rng(3).normal(0, 0.2, 700)
    sound[300:] *= 0.0001
    frames = [(5, i, sound[a : a + 90].tolist()) for i, a in enumerate(range(0, 700, 90))] + [(6, 0, [0.1] * 150), (7, 0, None), (8, 0, [None] + [0.1, -0.1] * 120)]
    got = speech.speaking_rates(spark.createDataFrame(frames, "key long, seq long, samples array<double>"), rate).orderBy("key", "t").collect()
    want = []
    for first in range(0, 301, 40):
        x = sound[first : first + 400]
        silent = np.sqrt((x**2).mean()) < 0.005 or np.sqrt((x[280:] ** 2).mean()) < 0.0025
        want.append((5, 0.5 + first / rate, 0.0 if silent else flux(x, rate)))
    rest = sound[320:]
    want.append((5, 0.5 + 320 / rate + len(rest) / rate, 0.0))
    want.append((8, 0.5 + 240 / rate, flux([0.1, -0.1] * 120, rate)))
    assert [r["key"] for r in got] == [w[0] for w in want]
    assert np.allclose([[r["t"], r["rate"]] for r in got], [w[1:] for w in want])
    assert got[0]["rate"] > 0 == got[-2]["rate"]


def test_segments_are_recognised_once(spark):
    samples = spark.createDataFrame([(1, float(t), w) for t, w in enumerate("a b c d e f g h".split())], "key long, t double, sound string")
    events = spark.createDataFrame([(1, 1.0, "start"), (1, 3.0, "end"), (1, 4.0, "start"), (1, 5.0, "end"), (1, 6.0, "start")], "key long, t double, event string")
    found = speech.segments(samples, events).groupBy("key", "segment").agg(F.array_join(F.array_sort(F.collect_list("sound")), "").alias("sound"))
    asked = speech.recognised(found, "sound", lambda texts: [t.upper() if "b" in t else None for t in texts])
    assert [(r["segment"], r["sound"]) for r in found.orderBy("segment").collect()] == [(1, "bcd"), (2, "ef")]
    assert [(r["segment"], r["text"]) for r in asked.collect()] == [(1, "BCD")]


def test_words_wait_in_pauses(spark):
    words = spark.createDataFrame([(1, i, 1) for i in range(4)] + [(2, 0, 1)], "key long, position long, units long")
    spoken = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0), (1, 5.0, 4.0), (1, 6.0, 8.0)], "key long, t double, spoken double")
    got = [tuple(r) for r in speech.word_times(words, spoken).orderBy("key", "position").collect()]
    assert got == [(1, 0, 0.0), (1, 1, 1.0), (1, 2, 5.0), (1, 3, 5.5), (2, 0, None)]


def test_sealed_messages_open_only_unchanged(spark):
    key = F.unhex(F.md5(F.lit("k")))
    bound = lambda role: history.bound_to_message(F.lit("u"), F.lit("a"), F.lit(role), F.lit(5))
    rows = spark.createDataFrame([("héllo",), ("",), ("x" * 5000,)], "text string").withColumn("s", history.sealed(F.col("text"), key, bound("user")))
    good = rows.select("text", history.opened(F.col("s.cipher"), F.col("s.nonce"), key, bound("user")).cast("string").alias("again"), history.opened(F.col("s.cipher"), F.col("s.nonce"), key, bound("system")).alias("swapped"), history.opened(F.col("s.cipher"), F.col("s.nonce"), F.unhex(F.md5(F.lit("other"))), bound("user")).alias("foreign"), "s.*").collect()
    assert all(r["again"] == r["text"] and r["swapped"] is None and r["foreign"] is None for r in good)
    assert len({r["nonce"] for r in good}) == 3 and not any(set("+/\r\n") & set(r["cipher"]) for r in good)


def test_keys_of_the_day_or_its_neighbours_or_the_legacy_key(spark):
    day = 86_400_000
    messages = spark.createDataFrame([(u, i * day) for u, i in ((1, 10), (1, 11), (1, 9), (1, 20), (2, 10))], "user_id long, ts long")
    days = lambda n: (datetime(1970, 1, 1) + timedelta(days=n)).strftime("%Y%m%d")
    keys = spark.createDataFrame([(1, days(10), b"ten"), (1, days(12), b"twelve"), (1, None, b"old")], "user_id long, day string, key binary")
    got = {(r["user_id"], r["ts"] // day): r["key"] and bytes(r["key"]) for r in history.with_keys(messages, keys).collect()}
    assert got == {(1, 10): b"ten", (1, 11): b"ten", (1, 9): b"ten", (1, 20): b"old", (2, 10): None}


def test_transcripts_lose_only_blanks_at_their_ends(spark):
    rows = [(1, 0, "interim", "x"), (1, 1, "final", " one\n"), (1, 2, "final", "two "), (1, 3, "interim", "th\n"), (1, 4, "end", None), (1, 5, "interim", "  "), (1, 6, "end", None)]
    got = streams.transcripts(spark.createDataFrame(rows, "key long, seq long, kind string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 4, "one\n two  th\n")]


def test_texts_are_cut_into_pieces_in_one_pass(spark):
    from skein.plans import streams as plans

    rows = spark.createDataFrame([(1, 0, "a\nb\U0001f600cdefg\r\nh"), (1, 1, ""), (2, 0, None), (3, 0, "1234567")], "conv_id long, turn int, text string")
    out = plans.pieces(rows, F.concat("text", F.lit("~")))
    got = [tuple(r) for r in out.orderBy("key", "seq").collect()]
    assert got == [(1, 0, "a\nb\U0001f600cde"), (1, 1, "fg\r\nh~"), (1, 2, None), (1, 1_000_000, "~"), (1, 1_000_001, None), (3, 0, "1234567"), (3, 1, "~"), (3, 2, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("~") == 1  # the text is made once, not for each piece
