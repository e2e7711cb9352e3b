"""Megabyte messages and pages of repeated tokens, and words that plain polynomials confuse."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import html, quotes, shingle_join

MEGABYTE = 1_000_000
MESSAGES = {
    ">": ">" * MEGABYTE, "> ": "> " * (MEGABYTE // 2), " >": " >" * (MEGABYTE // 2), "lines": "> a. b\n" * (MEGABYTE // 7), "blank lines": "On Monday X wrote:\n" + "\n" * MEGABYTE + "> a", "blanks": "x" + " " * MEGABYTE + "x",
    "announcements": "On x wrote:\n" * (MEGABYTE // 12), "starts": "on\n" * (MEGABYTE // 3), "sentences": "a. " * (MEGABYTE // 3), "tabs": "\t" * MEGABYTE,
}


def test_messages_of_a_megabyte(spark):
    """None ends the JVM, and none takes the square of its length."""
    rows = [(1, 0, "u", "a. b")] + [(1, i, "u", t) for i, t in enumerate(MESSAGES.values(), 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    began = time.perf_counter()
    got = {r["turn"]: r for r in quotes.conversations(df).select("turn", "n_quoted", "quote_level", "reply_to", F.length("text").alias("n")).collect()}
    assert time.perf_counter() - began < 120
    level = {n: got[i]["quote_level"] for i, n in enumerate(MESSAGES, 1)}
    assert level[">"] == MEGABYTE and level["> "] == MEGABYTE // 2 and level[" >"] == MEGABYTE // 2 and level["lines"] == 1 and level["blanks"] == 0
    assert got[list(MESSAGES).index("lines") + 1]["reply_to"] == 0 and got[list(MESSAGES).index("blank lines") + 1]["n"] == 0


@pytest.mark.parametrize("name", ["script", "style", "title", "textarea"])
def test_ends_of_raw_elements(name):
    """An end tag that never closes is looked for once."""
    for page in (f"<p>hi</p><{name}>" + f"</{name} " * 60_000, f"<p>hi</p><{name}>" + f"</{name} " * 60_000 + ">", f"<p>hi</p><{name}>" * 30_000 + f"</{name} x>", f"<{name}>a</{name}>" * 30_000 + "<p>hi</p>"):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 5
    assert html.main_text(f"<p>one two three</p><{name}>a</{name.upper()}\n x><p>four</p>").split("\n")[-1] == "four"


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_that_polynomials_confuse(n):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64 whatever the base."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = (shingle_join.shingles(f"x {w} y", 3) for w in (word, other))
    assert len(a) == len(b) == 1 and a[0] != b[0]
    assert (shingle_join.shingles(f"X  {word.upper()}\ny", 3) == a).all()


def test_sets_are_those_of_the_words(monkeypatch):
    """As many hashes as different sequences, equal for equal ones, wherever pieces of the text are cut."""
    rng = random.Random(3)
    for piece in (7, 64, shingle_join.TEXT_PIECE):
        monkeypatch.setattr(shingle_join, "TEXT_PIECE", piece)
        known: dict[int, tuple] = {}
        for _ in range(60):
            text = "".join(rng.choice(["a", "B", "é", " ", "\t", "\n", "aa", "\x0b", "word", " "]) for _ in range(rng.randrange(0, 60)))
            words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
            words = [w.replace("B", "b") for w in words]
            want = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
            got = shingle_join.shingles(text, 3)
            assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
            for w in want:
                h = shingle_join.shingles(" ".join(w), 3)
                assert len(h) == 1 and h[0] in got and known.setdefault(int(h[0]), w) == w


def test_a_long_text_takes_little_memory():
    """Less than twenty bytes for each byte of a text."""
    import tracemalloc

    text = "some words of a long text and " * 300_000
    shingle_join.shingles("warm up", 3)
    tracemalloc.start()
    shingle_join.shingles(text, 5)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 20 * len(text)
