"""Quality rules: base limits, then boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents, flattened into numpy
node arrays and sent to the tasks with the function; a block of documents is scored
at once. More symbols, repeats or repeated lines can only lower a document's score
(monotonic constraints).

Defined results: a null text has no words and fails the base limits; documents under
50 words fail; repeated rows are judged each for itself; without labels every document
that passes the base limits is kept; an empty table gives an empty result; further
columns are kept by ``keep_good`` and left out of the report.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_hash, pick
from skein.llm.gbdt import Trees, fit

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  #: per cent of the words
#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
#: Documents under this probability of being good go. Low, as a clean one lost is worse than a poor one kept.
THRESHOLD = 0.35
FEATURES = ("log_words", "symbols_per_word", "repeated_share", "dup_lines_share", "mean_word", "upper_share", "digit_share", "distinct_share", "words_per_line", "stops_per_word")
MONOTONE = {1: -1, 2: -1, 3: -1}


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    w = np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, n)
    k = len(seen)
    pair = w[:-1] * k + w[1:]
    if k > 1 << 20:  # else three numbers fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    raw = np.frombuffer(data, np.uint8)
    size = max(len(raw), 1)
    upper, digit = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw >= 48) & (raw <= 57)).sum())
    m = max(n, 1)
    features = [np.log1p(n), symbols / m, repeat / m, dup / max(len(lines), 1), chars / m, upper / size, digit / size, len(set(words)) / m, n / max(len(lines), 1), sum(map(text.count, ".!?")) / m]
    return (n, chars, symbols, dup, repeat), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled documents, chosen by a hash of their id."""
    # the sample's size is the bound of the broadcast
    chosen = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").orderBy(id_hash(F.col("doc_id")), "quality").limit(sample)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        for batch in batches:
            x = [statistics(t)[1] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy("doc_id", "quality", "x").limit(sample).collect()
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["quality"] > 0 for r in got], float), monotone=MONOTONE)


def _verdicts(texts: list[str | None], trees: Trees, threshold: float):
    stats, x = zip(*map(statistics, texts), strict=True)
    failed = np.array([base_failed(s[0], s[4]) for s in stats])
    # constant trees mean that there was nothing to learn from
    good = trees.probability(np.array(x)) >= threshold if trees.feature.max() >= 0 else np.ones(len(x), bool)
    return stats, failed, ~failed & good


def quality_report(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The statistics and the verdict of every document; no shuffle."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                stats, failed, kept = _verdicts(batch.column(1).to_pylist(), trees, threshold)
                columns = [pa.array(c, pa.int64()) for c in zip(*stats, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns, pa.array(failed), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns; no shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_verdicts(batch.column(at).to_pylist(), trees, threshold)[2]))

    return docs.mapInArrow(run, docs.schema)
