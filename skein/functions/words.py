"""Word-level helpers that columns can't express: hyphenation, replacement, error rate, offsets."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import SPACE, strip

#: Array of (token, start, end).
PLACED = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def replaced_words(text: Column, replacements: dict[str, str]) -> Column:
    """T8. Whole words replaced, case ignored; the punctuation behind a word stays, as does white space.

    One pass by an alternation of the words, longest first, keeps it in the JVM.
    """
    out = text
    marks = r"!-/:-@\[-`{-~"
    for word, to in sorted(replacements.items(), key=lambda x: -len(x[0])):
        pattern = rf"(?i)(?<![^{SPACE[1:-1]}]){re.escape(word)}(?=[{marks}]*(?:{SPACE}|$))"
        out = F.regexp_replace(out, pattern, to.replace("\\", "\\\\").replace("$", "\\$"))
    return out


@F.udf(returnType=PLACED, useArrow=True)
def word_offsets(text):
    """T4. Words with their places (end exclusive)."""
    return [{"token": m[0], "start": m.start(), "end": m.end()} for m in re.finditer(r"\S+", text or "")]


@F.udf(returnType=PLACED, useArrow=True)
def paragraph_offsets(text):
    """T5. Paragraphs, stripped, with their places."""
    out, at = [], 0
    text = text or ""
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        part = text[at : m.start() if m else len(text)]
        if s := part.strip():
            start = at + part.index(s)
            out.append({"token": s, "start": start, "end": start + len(s)})
        at = m.end() if m else at
    return out


def character_words(text: Column) -> Column:
    """T4. Words where every CJK, kana or Thai character is one of its own."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{0e00}-\x{0e7f}])", " $1 ")
    return F.filter(F.split(strip(spaced), f"{SPACE}+"), lambda w: w != "")


def word_errors(said: str, truth: str) -> float:
    """A25. Word edit distance over the number of true words, a row of the table at a time."""
    a, b = said.split(), np.array(truth.split(), object)
    at = np.arange(len(b) + 1)
    row = at
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(new - at) + at
    return float(row[-1]) / max(len(b), 1)


@F.pandas_udf(T.DoubleType())
def word_error_rate(said: pd.Series, truth: pd.Series) -> pd.Series:
    """A25. Word error rate of pairs of texts."""
    return pd.Series([None if s is None or t is None else word_errors(s, t) for s, t in zip(said, truth, strict=True)])
