from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import words as Wd
from skein.operators import chunking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""),
        ("a.......b", "a...b"),
        ("one\n 12 \ntwo", "one two"),
        ("one\n1234\ntwo", "one 1234 two"),
        ("a b c – d—e", "a b c - d-e"),
        ("so­ft…", "soft..."),
        ("  a \t\n b  ", "a b"),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, text, X.clean) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, False),
        ("too short", False),
        ("these are five real words here", True),
        ("Chapter .......................... 12 one two three four", False),
        ("12345678901234567890 a few real words are here now", False),
        ("ab cd ef gh ij kl mn op qr", False),
    ],
)
def test_valid_chunk(spark, text, want):
    assert one(spark, text, X.valid_chunk) is want


def test_spoken_and_unsafe(spark):
    assert one(spark, "a—b ﬁx €5 中\U0001f600 é…", X.spoken) == "a-b fix €5 é..."
    assert one(spark, "中a中\U0001f600ﬁ–", X.unsafe_characters) == ["中", "\U0001f600"]


@pytest.mark.parametrize(("text", "want"), [("Annual report 2021 (v2)", "2021"), ("x20211", None), ("1999", None), ("2030-2031", "2030")])
def test_year(spark, text, want):
    assert one(spark, text, X.year_of) == want


def test_terms_know_letters_of_all_languages(spark):
    assert one(spark, "Été, naïve_2 x", X.terms) == ["été", "naïve_2", "x"]


def test_truncate(spark):
    assert one(spark, "a" * 40, lambda t: X.truncated(t, 10)) == "a" * 40
    assert one(spark, "a" * 36 + ". bcdefgh", lambda t: X.truncated(t, 10)) == "a" * 36 + ". "
    assert one(spark, "ab. " + "c" * 60, lambda t: X.truncated(t, 10)) == "ab. " + "c" * 36 + "..."


MARKDOWN = [
    ("# Head", "Head"), ("- item", "item"), ("> said", "said"), ("a **bold** b", "a bold b"), ("an *it* b", "an it b"), ("__u__ and _v_", "u and v"),
    ("[text](http://x)", "text"), ("![alt](u)", "alt"), ("`code`", "code"), ("```python", ""), ("~~gone~~ left", " left"), ("2*3*4", "2*3*4"), ("snake_case_name", "snake_case_name"),
]


@pytest.mark.parametrize(("text", "want"), MARKDOWN)
def test_markdown(spark, text, want):
    assert one(spark, text, X.plain_markdown) == want


def test_emoji(spark):
    assert one(spark, "a\U0001f600️ b ❤️‍\U0001f525c 1⃣", X.without_emoji) == "a b c 1"


@pytest.mark.parametrize(("text", "want"), [(" het een niet voor ", "Dutch"), (" the and that with ", "English"), ("", "Dutch"), (" the het ", "Dutch"), (" worden the ", "Dutch"), ("x" * 3000 + " the and that ", "Dutch")])
def test_language(spark, text, want):
    assert one(spark, text, X.language) == want


@pytest.mark.parametrize(
    ("q", "a", "want"),
    [
        ("why?", None, "missing"),
        ("  ", "x", "empty"),
        ("w " * 80, "x", "too long"),
        ("why?", "According to the report it is.", "filler: according to the report"),
        ("why?", "It is mandatory.", "assumption: is mandatory"),
        ("why?", "The law explicitly is mandatory.", None),
        ("why?", "In handers we trust", "assumption: anders"),
        ("why?", "Because.", None),
    ],
)
def test_qa(spark, q, a, want):
    row = spark.createDataFrame([(q, a)], "q string, a string").select(X.qa_verdict(F.col("q"), F.col("a")).alias("x"))
    assert row.first()["x"] == want


def test_words_and_places(spark):
    text = "This is a test. Blabla another test! multiple consecutive spaces:     done"
    assert one(spark, text, X.words) == "This is a test Blabla another test multiple consecutive spaces done".split()
    assert one(spark, "ab 中文c", Wd.character_words) == ["ab", "中", "文", "c"]
    assert [tuple(x) for x in one(spark, " ab  c", Wd.word_offsets)] == [("ab", 1, 3), ("c", 5, 6)]


PARAGRAPHS = [
    ("One paragraph.", [("One paragraph.", 0, 14)]),
    ("Para 1.\n\nPara 2.", [("Para 1.", 0, 7), ("Para 2.", 9, 16)]),
    ("\n\n  Padded text.  \n\n", [("Padded text.", 4, 16)]),
    ("Para 1.\n \n \nPara 2.", [("Para 1.", 0, 7), ("Para 2.", 12, 19)]),
    ("", []),
    ("\n\n\n", []),
    ("Line 1\nLine 2", [("Line 1\nLine 2", 0, 13)]),
]


@pytest.mark.parametrize(("text", "want"), PARAGRAPHS)
def test_paragraphs(spark, text, want):
    assert [tuple(x) for x in one(spark, text, Wd.paragraph_offsets)] == want
    assert one(spark, text, X.paragraphs) == [w for w, _, _ in want]


def test_replaced_words(spark):
    text = "Hello world, my agents..     framework. Once again framework.  A.B.C worldly"
    change = {"world": "universe", "framework": "library", "a.b.c": "A.B.C.D", "once": "twice", "agents": "assistants"}
    assert one(spark, text, lambda t: Wd.replaced_words(t, change)) == "Hello universe, my assistants..     library. twice again library.  A.B.C.D worldly"


def test_rule_sentences(spark):
    text = "Hi! We build tools for audio and for video. \n\nR.T.C stands for something... again R.T.C. Mr. Theo tests the splitter. A short one.\nA longer one that is longer than all of the others. f(x) = x * 2.54 + 42. 这是一个中文句子。これは日本語の文章です。 The end"
    assert one(spark, text, chunking.rule_sentences) == [
        "Hi! We build tools for audio and for video.",
        "R.T.C stands for something... again R.T.C.",
        "Mr. Theo tests the splitter.",
        "A short one. A longer one that is longer than all of the others.",
        "f(x) = x * 2.54 + 42.",
        "这是一个中文句子。 これは日本語の文章です。",
        "The end",
    ]


def test_rule_sentences_run_their_patterns_once(spark):
    assert one(spark, "", chunking.rule_sentences) == [] and one(spark, " \u3000.\x1c", chunking.rule_sentences) == ["."]
    assert one(spark, "\u2003Mrs. A and St. B met Mr.. X \x85!\u00a0So they did, as we all know well.\u2029", chunking.rule_sentences) == ["Mrs. A and St. B met Mr..", "X \x85! So they did, as we all know well."]
    assert one(spark, "\nA. \n", lambda t: chunking.rule_sentences(t, keep_format=True)) == ["\nA. \n"]
    plan = spark.range(1).select(chunking.rule_sentences(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(com|net|org|io|gov|edu|me)") == 1


def test_word_errors(spark):
    assert Wd.word_errors("a b c", "a x c d") == 0.5
    assert Wd.word_errors("", "a") == 1.0


def test_chunks():
    text = " ".join(f"Sentence number {i} is here for a test." for i in range(60))
    found = chunking.pack_sentences(text)
    assert [c[0] for c in found] == list(range(len(found)))
    for _, t, tokens, a, b, cut in found:
        assert len(t) <= chunking.HARD_CHARS and tokens <= chunking.TARGET_TOKENS and not cut and text[a:b].startswith(t[:20])
    for x, y in zip(found, found[1:]):
        n = x[1].count(".")
        assert y[1].startswith(" ".join(x[1].split(". ")[n - int(n * 0.25) :])[:30])
    assert chunking.pack_sentences("") == [] and chunking.pack_sentences("  ") == []
    assert chunking.pack_sentences("x" * 600)[0][1:] == ("x" * 520, 150.0, 0, 600, True)


def test_sections():
    parts = ["a" * 400, "b" * 400, "c" * 40, "d" * 400]
    assert chunking.pack_sections(parts, target=210, overlap=20) == [(1, 0, 2, 210), (2, 2, 3, 110)]
    assert chunking.pack_sections(["x" * 4000], target=10) == [(1, 0, 0, 1000)]
    assert chunking.pack_sections([]) == []


def test_expansion(spark):
    full = "First one here. Second one is the chunk. Third one follows. " + "z" * 600
    start = full.index("Second")
    rows = spark.createDataFrame([(full, "Second one is the chunk.", start, start + 24), ("q" * 700, "q" * 600, 0, 600), ("q" * 700, "q" * 480, 0, 480)], "full string, text string, char_start int, char_end int")
    got = [r["expanded"] for r in chunking.expanded(rows).collect()]
    assert got[0].startswith("[...First one here.] Second one is the chunk. [Third one follows.") and len(got[0]) <= 512
    assert got[1] == "q" * 512 and got[2] == "q" * 480
