"""T2. Sentence splitting by a model that is learned from the corpus itself, without labels.

After Kiss and Strunk's method: an abbreviation is a word that stands with a full stop far more
often than chance, is short, and rarely stands without one; words that begin
sentences, and pairs that hold together across a full stop, are found by likelihood
ratios too. Counts are taken over the whole corpus by one pass; the model is a small
table of what passed its threshold, and splitting is made of expressions.

Behind an abbreviation or an initial a sentence ends only before a known beginning; behind
a number only before a word that isn't in lower case; between the words of a pair never;
behind any other word, and behind ! and ?, always.

Defined results: null and empty texts have no sentences; counts make the model the same on every run.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import arrays as A
from skein.functions import text as X
from skein.sources import scratch

ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
LEAST_PAIR = 3  #: times that a pair has to occur
MOST = 20_000  #: abbreviations, and beginnings, that a model may hold; beyond, it is an error
LONGEST = 64  #: characters in which the words at a full stop are looked for
END = "\ue003"  #: a private character between sentences
CLOSERS = r"[\"'”’»)\]]*"


class Model(NamedTuple):
    """Abbreviations, beginnings and pairs, in lower case."""

    abbreviations: list[str]
    starters: list[str]
    pairs: list[str]


def tokens(docs: DataFrame) -> DataFrame:
    """word (lower case, without marks around and the last full stop), stop (whether it had one), next, capital (the next begins with a capital), n (how often).

    Tokens are counted as they stand before any pattern meets them; what comes next is kept
    behind a full stop only, so that there are hardly more rows than words.
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\t-\r ]+"), F.lit(0))
    pairs = docs.select(F.explode(F.arrays_zip(found.alias("a"), F.concat(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.array(F.lit(None).cast("string"))).alias("b"))).alias("p"))
    pairs = pairs.select(F.col("p.a").alias("a"), F.when(F.contains("p.a", F.lit(".")), F.col("p.b")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    bare = lambda c: F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}.]+|[^\p{L}\p{N}.]+$", "")
    rows = pairs.select(bare(F.col("a")).alias("w"), F.regexp_replace(bare(F.col("b")), r"[.]$", "").alias("next"), F.coalesce(F.col("b").rlike(r"^[^\p{L}\p{N}]*\p{Lu}"), F.lit(False)).alias("capital"), "n")
    stop = F.endswith("w", F.lit("."))
    rows = rows.select(F.regexp_replace("w", r"[.]$", "").alias("word"), stop.alias("stop"), F.when(stop, F.col("next")).alias("next"), (stop & F.col("capital")).alias("capital"), "n").where(r"word rlike '[\\p{L}\\p{N}]'")
    return rows.groupBy("word", "stop", "next", "capital").agg(F.sum("n").alias("n"))


def _ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio that ``b`` follows ``a`` more often than chance."""
    def bits(k: Column, m: Column, p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.ln(q) + (m - k) * F.ln(1 - q)

    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    return -2 * (bits(both, a, p) + bits(b - both, n - a, p) - bits(both, a, p1) - bits(b - both, n - a, p2))


def abbreviations(counts: DataFrame) -> DataFrame:
    """word, score: ``counts`` has word, n (occurrences), k (those with a full stop)."""
    total = counts.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    rows = counts.where(r"k > 0 and not word rlike '^[0-9.,]+$'").crossJoin(F.broadcast(total))  # one row
    p = F.col("_k") / F.col("_n")
    chance = F.col("k") * F.ln(p) + (F.col("n") - F.col("k")) * F.ln(F.greatest(1 - p, F.lit(1e-12)))
    held = F.col("k") * math.log(0.99) + (F.col("n") - F.col("k")) * math.log(0.01)
    dots = X.count_of(F.col("word"), ".")
    letters = F.length("word") - dots
    score = -2 * (chance - held) * F.exp(-letters) * (dots + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -(F.col("n") - F.col("k")))
    return rows.select("word", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("k"))


def fit(docs: DataFrame) -> Model:
    """The model of a table of documents (text), which is read once."""
    rows = scratch.written(tokens(docs), "tokens")
    counts = scratch.written(counted(rows), "words")
    short = _words(abbreviations(counts).select("word"))
    # an end is a full stop behind a word that is no abbreviation, initial or number
    end = F.col("stop") & ~F.col("word").isin(short) & (F.length("word") > 1) & ~F.col("word").rlike(r"^[0-9.,]+$")
    n, ends = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(end, F.col("n"))), F.lit(0))).collect()[0]
    begins = rows.where(end & F.col("capital") & F.col("next").isNotNull()).groupBy("next").agg(F.sum("n").alias("both"))
    first = begins.join(counts, begins["next"] == counts["word"]).withColumn("score", _ratio(F.col("both"), F.lit(ends), F.col("n"), F.lit(n)))
    starters = _words(first.where((F.col("score") >= STARTER) & (F.col("both") / max(ends, 1) > F.col("n") / max(n, 1))).select("word"))
    held = rows.where(F.col("stop") & F.col("next").isNotNull() & (F.col("word").isin(short) | (F.length("word") == 1) | F.col("word").rlike(r"^[0-9.,]+$")))
    pairs = held.groupBy("word", "next").agg(F.sum("n").alias("both")).where(F.col("both") >= LEAST_PAIR)
    a, b = counts.select("word", F.col("n").alias("a")), counts.select(F.col("word").alias("next"), F.col("n").alias("b"))
    pairs = pairs.join(a, "word").join(b, "next").withColumn("score", _ratio(F.col("both"), F.col("a"), F.col("b"), F.lit(n)))
    pairs = pairs.where((F.col("score") >= COLLOCATION) & (F.col("both") / F.col("a") > F.col("b") / max(n, 1)) & ~F.col("next").isin(starters))
    return Model(short, starters, _words(pairs.select(F.concat_ws(" ", "word", "next").alias("word"))))


def _words(rows: DataFrame) -> list[str]:
    found = sorted(r[0] for r in rows.limit(MOST + 1).collect())
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} words passed a threshold; the texts may not be prose")
    return found


def sentences(text: Column, model: Model) -> Column:
    """Array of sentences by a model, stripped; empty ones are dropped."""
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"([.!?]{CLOSERS}{X.SPACE}++)(?=\S)", f"$1{END}"), END)
    among = lambda w, known: w.isin(known) if known else F.lit(False)
    heads = sorted({p.split(" ")[0] for p in model.pairs})

    def marked(all_: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            # longer words are neither abbreviations nor beginnings
            last = F.regexp_replace(F.lower(F.regexp_extract(F.right(piece, F.lit(LONGEST)), rf"(\S+?)[.]{CLOSERS}{X.SPACE}*$", 1)), r"^[^\p{L}\p{N}.]+", "")
            return A.let(last, lambda w: judged(piece, i, w))

        def judged(piece: Column, i: Column, last: Column) -> Column:
            """What comes next is looked at only behind a word for which it matters, and once."""
            held = among(last, model.abbreviations) | (F.length(last) == 1) & last.rlike(r"\p{L}")
            number = last.rlike(r"^[0-9.,]+$")
            behind = F.left(F.coalesce(F.get(all_, i + 1), F.lit("")), F.lit(LONGEST))
            stays = A.let(behind, lambda b: A.let(F.regexp_replace(F.lower(F.regexp_extract(b, r"^[^\p{L}\p{N}]*(\S+)", 1)), r"[^\p{L}\p{N}]+$", ""), lambda f: kept(last, b, f, held, number)))
            asked = (last != "") & (among(last, heads) | held | number)
            return F.when(asked, F.when(stays, piece).otherwise(F.concat(piece, F.lit(END)))).otherwise(F.concat(piece, F.lit(END)))

        def kept(last: Column, behind: Column, following: Column, held: Column, number: Column) -> Column:
            return (held & ~(among(following, model.starters) & behind.rlike(r"^[^\p{L}\p{N}]*\p{Lu}"))) | number & behind.rlike(r"^[^\p{L}\p{N}]*\p{Ll}") | among(F.concat_ws(" ", last, following), model.pairs)

        return F.transform(all_, one)

    joined = F.array_join(F.element_at(F.transform(F.array(pieces), marked), 1), "")
    return F.filter(F.transform(F.split(joined, END), lambda s: F.btrim(s, F.lit(X.BLANKS))), lambda s: s != "")
