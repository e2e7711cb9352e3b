"""A megabyte of each repeated token through every text function: none ends the JVM, none takes the square of its length."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import words as Wd
from skein.operators import chunking
from skein.sources import readers

MEGABYTE = 1_000_000
TOKENS = ("[", "![", "[a](", "[a]", "](", "*", " **", "**a", "_", " __a", "`", "~~", "~~a", " ", "\n", " \n", "\t", "\xa0", "\xa0\n", ".", ". ", "a. ", "A.", "a.B.", "> ", ">", "a", "a@", "b.", "<", "0", "1 ", "\n1\n", "-", "(", '"', "[Page 1]", "\U0001f600", "é", "the!", "Mr. ", "<think>", "# ", "```", "|")
FUNCTIONS = {
    "strip": X.strip, "clean": X.clean, "valid_chunk": X.valid_chunk, "spoken": X.spoken, "unsafe": X.unsafe_characters, "year": X.year_of, "context": lambda t: X.context_of(t, "zz"), "email": X.email_ok,
    "sentences": X.sentences, "words": X.words, "paragraphs": X.paragraphs, "terms": X.terms, "word_tokens": X.word_tokens, "truncated": lambda t: X.truncated(t, 200_000), "markdown": X.plain_markdown, "emoji": X.without_emoji,
    "language": X.language, "ends_turn": X.ends_turn, "speaker": X.ignored_speaker, "verdict": lambda t: X.qa_verdict(t, t), "room": X.user_of_room, "secure": X.secure_name, "interrupts": lambda t: X.interrupts(t, F.lit(1.0), 2, 0.5),
    "rules": chunking.rule_sentences, "replaced": lambda t: Wd.replaced_words(t, {"the": "THAT"}), "characters": Wd.character_words, "pages": readers.pages_of, "turn": X.turn_text,
}


@pytest.fixture(scope="module")
def texts(spark):
    around = [t * (MEGABYTE // len(t)) for t in TOKENS]
    around += ["a@" + "b." * (MEGABYTE // 2) + "c", "x" + " " * MEGABYTE + "x", "x" + "\n " * (MEGABYTE // 2) + "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(around)], "i long, t string").repartition(8).persist()
    rows.count()
    return rows


@pytest.mark.parametrize("name", FUNCTIONS)
def test_megabytes(texts, name):
    began = time.perf_counter()
    # a digest of all results, which no plan can leave out
    assert texts.select(F.xxhash64(FUNCTIONS[name](F.col("t"))).alias("h")).agg(F.bit_xor("h")).collect()[0][0] is not None
    assert time.perf_counter() - began < 60  # for all of them on eight threads


@pytest.mark.parametrize(("text", "plain"), [("[[a](b)", "[a"), ("[a][b](c)", "[a]b"), ("![x](y)![z](w) [q](", "xz [q]("), ("[a](b", "[a](b"), ("![a] [b](c) [", "![a] b ["), ("[](x)[]", "[]")])
def test_links(spark, text, plain):
    """What the rules leave, link by link."""
    assert spark.createDataFrame([(text,)], "t string").select(X.plain_inline(F.col("t"))).collect()[0][0] == plain


def test_links_as_plain_patterns_see_them(spark):
    rng = random.Random(5)
    known = [("".join(rng.choice("[[]]()!a") for _ in range(rng.randrange(1, 30))),) for _ in range(3000)]
    for text, plain in spark.createDataFrame(known, "t string").select("t", X.plain_inline(F.col("t"))).collect():
        assert plain == re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)), text


def test_page_numbers_as_a_plain_pattern_sees_them(spark):
    rng = random.Random(6)
    known = [("".join(rng.choice("\n\n \xa0\t1234a.\r") for _ in range(rng.randrange(1, 30))),) for _ in range(3000)]
    for text, plain in spark.createDataFrame(known, "t string").select("t", X.clean(F.col("t"))).collect():
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{4,}", " ", re.sub(r"\.{4,}", "...", text)))
        t = re.sub(r"(?m)^\s*[0-9]{1,3}\s*$", "", t)
        assert plain == re.sub(r"\s+", " ", t).strip(), repr(text)


@pytest.mark.parametrize(("text", "plain"), [("a\n12\nb", "a b"), ("1\n2\n3", ""), ("a\n\n 1 \n\n2\nb 3\n", "a b 3"), ("7", ""), ("a 12\nb", "a 12 b"), ("a\n1234\n", "a 1234"), ("\xa05\xa0\nx", "x"), ("a......b…", "a...b..."), ("a\r\n9\r\nb", "a b")])
def test_page_numbers(spark, text, plain):
    assert spark.createDataFrame([(text,)], "t string").select(X.clean(F.col("t"))).collect()[0][0] == plain
