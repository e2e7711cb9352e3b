"""Sentence splitting, chunking and context around chunks.

Packing is a fold over one document, without a shuffle: sentences in Arrow batches of
documents, all else in expressions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import arrays as A
from skein.functions import text as X

TARGET_TOKENS, HARD_CHARS, OVERLAP = 128, 520, 0.25
SECTION_TOKENS, SECTION_OVERLAP = 10_000, 500
EXPANDED_CHARS, EXPANSION_TOKENS = 512, 256
MARKS = (". ", "? ", "! ", "\n\n", "\n")

#: Where a full stop doesn't end a sentence, in order; the groups stay, DOT stands for the stop. Fixed values.
DOT, STOP = "", ""
STARTERS = r"(Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever)"
KEPT_DOTS = (
    (r"[.](?<=(?:Mr|St|Mrs|Ms|Dr)[.])", DOT),
    (r"[.](com|net|org|io|gov|edu|me)", rf"{DOT}$1"),
    (r"([0-9])[.]([0-9])", rf"$1{DOT}$2"),
    (r"[.](?=[.])|(?<=[.])[.]", DOT),
    (r"Ph[.]D[.]", f"Ph{DOT}D{DOT}"),
    (r"\s([A-Za-z])[.] ", rf" $1{DOT} "),
    (rf"([A-Z][.][A-Z][.](?:[A-Z][.])?) {STARTERS}", rf"$1{STOP} $2"),
    (r"([A-Za-z])[.]([A-Za-z])[.]([A-Za-z])[.]", rf"$1{DOT}$2{DOT}$3{DOT}"),
    (r"([A-Za-z])[.]([A-Za-z])[.]", rf"$1{DOT}$2{DOT}"),
    (rf" (Inc|Ltd|Jr|Sr|Co)[.] {STARTERS}", rf" $1{STOP} $2"),
    (r" (Inc|Ltd|Jr|Sr|Co)[.]", rf" $1{DOT}"),
    (r" ([A-Za-z])[.]", rf" $1{DOT}"),
    (r"([.!?。！？][\"”]?)", rf"$1{STOP}"),
)


def rule_sentences(text: Column, least: int = 20, keep_format: bool = False) -> Column:
    """T3. Sentences by rules for abbreviations, acronyms, numbers and CJK stops; short ones join the next."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, "\n", f"\n{STOP}" if keep_format else " ")
    for pattern, to in KEPT_DOTS:
        t = F.regexp_replace(t, pattern, to)
    parts = F.split(F.translate(t, DOT, "."), STOP)
    parts = F.filter(parts if keep_format else F.transform(parts, lambda s: F.btrim(s, F.lit(X.BLANKS))), lambda s: s != "")
    # a run is the fewest parts with more than ``least`` characters, a blank before each counted: patterns cut them, as a fold's array would be copied for each part
    joined = F.concat(F.array_join(parts, STOP), F.lit(STOP))  # of no parts a mark alone, which goes below; parts are named once, as every naming runs all patterns
    run = rf"((?:[^{STOP}]{STOP}?+){{{least}}}[^{STOP}]++){STOP}" if keep_format else rf"([\s\S]{{{least}}}[^{STOP}]*+){STOP}"
    # what stands between the sentences of a run is changed in the whole text, before it is cut, as no sentence holds a mark
    runs = F.translate(F.rtrim(F.regexp_replace(joined, run, f"$1{DOT}"), F.lit(STOP)), STOP, "" if keep_format else " ")
    return F.filter(F.split(runs, DOT), lambda s: s != "")


def _split(text: str) -> list[tuple[str, int, int]]:
    """Sentences with their places: split behind . ! ? and white space."""
    out, at = [], 0
    for part in re.split(r"(?<=[.!?])\s+", text):
        if s := part.strip():
            start = text.find(s, at)
            out.append((s, start, start + len(s)))
            at = start + len(s)
    return out


def pack_sentences(text: str, target: int = TARGET_TOKENS, hard: int = HARD_CHARS, overlap: float = OVERLAP) -> list[tuple[int, str, float, int, int, bool]]:
    """(index, text, tokens, start, end, truncated): sentences in runs of at most ``target`` tokens.

    A run that is full hands its last quarter of sentences on to the next one. A
    text over ``hard`` characters is cut, and says so.
    """
    sentences = _split(text)
    chunks, first = [], 0

    def close(end: int) -> None:
        run = sentences[first:end]
        joined = " ".join(s for s, _, _ in run)
        chunks.append((len(chunks), joined[:hard], sum(len(s) for s, _, _ in run) / X.CHARS_PER_TOKEN, run[0][1], run[-1][2], len(joined) > hard))

    held = 0
    for i, (s, _, _) in enumerate(sentences):
        if held and held + len(s) > target * X.CHARS_PER_TOKEN:
            close(i)
            first = i - int((i - first) * overlap)
            held = sum(len(x) for x, _, _ in sentences[first:i])
        held += len(s)
    if sentences:
        close(len(sentences))
    return chunks


def chunks(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """T11. Chunks of documents, before those that aren't prose are dropped (``valid_chunk``)."""
    schema = f"{key} long, chunk_index int, text string, est_tokens double, char_start int, char_end int, truncated boolean"

    def run(batches):
        for batch in A.pieces(batches):
            rows = [(k, *c) for k, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) for c in pack_sentences(t or "", **options)]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(key, "text").mapInArrow(run, schema)


def good_chunks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """T11 and P2: numbered before the invalid ones go, so that numbers may have gaps."""
    return chunks(docs, key).where(X.valid_chunk(F.col("text")))


def pack_sections(sections: list[str], target: int = SECTION_TOKENS, overlap: int = SECTION_OVERLAP) -> list[tuple[int, int, int, int]]:
    """(chunk, first section, last section, tokens): whole sections up to ``target`` tokens.

    The next chunk starts with as many of the last sections as fit into ``overlap`` tokens.
    """
    size = [len(s) // X.CHARS_PER_TOKEN for s in sections]
    out, first = [], 0
    held = 0
    for i, n in enumerate(size):
        if i > first and held + n > target:
            out.append((len(out) + 1, first, i - 1, held))
            back, kept = i, 0
            while back > first + 1 and kept + size[back - 1] <= overlap:
                back -= 1
                kept += size[back]
            first, held = back, kept
        held += n
    if sections:
        out.append((len(out) + 1, first, len(sections) - 1, held))
    return out


def _packed_sections(sizes: Column, target: int, overlap: int) -> Column:
    """``pack_sections`` as a fold over the sections' tokens: array of (first, last, tokens).

    The fold holds the chunks as lines of text, as Spark copies what it holds for each section,
    an array item by item. Only a chunk that is full adds a line or looks back.
    """

    def back(first: Column, i: Column, z: Column) -> Column:  # how many of the last sections fit into the overlap, and their tokens
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("kept"), F.lit(True).alias("open"))
        state = lambda n, kept, fits: F.struct(n.alias("n"), kept.alias("kept"), F.lit(fits).alias("open"))
        step = lambda a, x: F.when(a["open"] & (a["kept"] + x <= overlap), state(a["n"] + 1, a["kept"] + x, True)).otherwise(state(a["n"], a["kept"], False))
        behind = F.when(i - first > 1, F.sequence(i - 1, first + 1, F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(behind, start, lambda a, j: step(a, F.get(z, j)))

    def chunk(a: Column, end: Column) -> Column:
        return F.concat(a["out"], F.concat_ws(" ", *(c.cast("string") for c in (a["first"], end - 1, a["held"]))))

    def fold(z: Column) -> Column:
        state = lambda first, held, out: F.struct(first.alias("first"), held.alias("held"), out.alias("out"))

        def add(a: Column, x: Column) -> Column:
            full = (x["i"] > a["first"]) & (a["held"] + x["n"] > target)
            closed = A.let(back(a["first"], x["i"], z), lambda b: state(x["i"] - b["n"], b["kept"] + x["n"], F.concat(chunk(a, x["i"]), F.lit("\n"))))
            return F.when(full, closed).otherwise(state(a["first"], a["held"] + x["n"], a["out"]))

        numbered = F.transform(z, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
        return F.aggregate(numbered, state(F.lit(0), F.lit(0).cast("long"), F.lit("")), add, lambda a: chunk(a, F.size(z)))

    def read(line: Column) -> Column:
        return A.let(F.split(line, " "), lambda w: F.struct(F.get(w, 0).cast("int").alias("first"), F.get(w, 1).cast("int").alias("last"), F.get(w, 2).cast("long").alias("tokens")))

    return F.when(F.size(sizes) > 0, F.transform(F.split(A.let(sizes, fold), "\n"), read))


def section_chunks(docs: DataFrame, key: str = "doc_id", target: int = SECTION_TOKENS, overlap: int = SECTION_OVERLAP) -> DataFrame:
    """T12, T13. Paragraphs packed into chunks, each with its range, number, count and title suffix; expressions alone."""

    def cut(parts: Column) -> Column:
        sizes = F.transform(parts, lambda s: F.floor(F.length(s) / X.CHARS_PER_TOKEN))
        text = lambda c: F.array_join(F.transform(F.sequence(c["first"], c["last"]), lambda j: F.get(parts, j)), "\n\n")  # a slice would copy all parts for each chunk
        numbered = lambda found: F.transform(found, lambda c, i: F.struct((i + 1).alias("chunk_num"), F.size(found).alias("total_chunks"), c["first"].alias("first"), c["last"].alias("last"), c["tokens"].alias("tokens"), text(c).alias("text")))
        return A.let(_packed_sections(sizes, target, overlap), numbered)

    packed = docs.select(key, F.inline(A.let(X.paragraphs(F.col("text")), cut)))
    return packed.withColumn("title", title(F.col("chunk_num"), F.col("total_chunks"), F.col("first") + 1, F.col("last") + 1))


def title(n: Column, total: Column, first: Column, last: Column) -> Column:
    """T13. What a chunk adds to its document's title; nothing for the only one."""
    pages = F.when(first == last, F.format_string("Pagina %d", first)).otherwise(F.format_string("Pagina's %d-%d", first, last))
    return F.when(total > 1, F.concat(F.format_string(" (Deel %d/%d, ", n, total), F.coalesce(pages, F.lit("")), F.lit(")"))).otherwise("")


def _last(text: Column, mark: str) -> Column:
    """0-based place of the last occurrence, -1 if none."""
    return F.when(F.instr(text, mark) > 0, F.length(text) - F.instr(F.reverse(text), mark[::-1]) - len(mark) + 1).otherwise(-1)


def expanded(rows: DataFrame, most: int = EXPANDED_CHARS, tokens: int = EXPANSION_TOKENS) -> DataFrame:
    """T14. Chunks (full, text, char_start, char_end) with what stands around them, up to ``most`` characters, as ``expanded``.

    Each side goes out by the room that is left, then back in to the first kind of
    sentence border found there. Chunks with 50 characters of room or less stay.
    """
    c = F.col
    steps = rows.withColumn("_room", F.lit(most) - F.length("text"))
    steps = steps.withColumn("_reach", (F.least(F.lit(tokens), F.floor(c("_room") / X.CHARS_PER_TOKEN)) * X.CHARS_PER_TOKEN).cast("int"))
    steps = steps.withColumns({"_l": F.greatest(F.lit(0), c("char_start") - c("_reach")), "_r": F.least(F.length("full"), c("char_end") + c("_reach"))})
    steps = steps.withColumns({"_before": F.substring(c("full"), c("_l") + 1, c("char_start") - c("_l")), "_after": F.substring(c("full"), c("char_end") + 1, c("_r") - c("char_end"))})
    cut_left = F.coalesce(*(F.when(_last(c("_before"), m) >= 0, _last(c("_before"), m) + len(m)) for m in MARKS), F.lit(0))
    cut_right = F.coalesce(*(F.when(F.instr("_after", m) > 0, F.instr("_after", m) - 1 + len(m.rstrip())) for m in MARKS), F.length("_after"))
    steps = steps.withColumns({"_cl": F.when(c("_l") > 0, cut_left).otherwise(0), "_cr": F.when(c("_r") < F.length("full"), cut_right).otherwise(F.length("_after"))})
    steps = steps.withColumns({"_pre": X.strip(F.substring(c("_before"), c("_cl") + 1, F.length("_before"))), "_post": X.strip(F.substring(c("_after"), F.lit(1), c("_cr")))})
    around = (c("_pre") != "") | (c("_post") != "")
    steps = steps.withColumns({"_head": F.when(around, F.concat(F.lit("[..."), "_pre", F.lit("] "))).otherwise(""), "_tail": F.when(around, F.concat(F.lit(" ["), "_post", F.lit("...]"))).otherwise("")})
    half = F.floor(c("_room") / 2).cast("int")
    steps = steps.withColumns({"_wide": F.concat("_head", "text", "_tail"), "_h": F.when(F.length("_head") > half, F.concat(F.lit("..."), F.right("_head", half))).otherwise(c("_head")), "_t": F.when(F.length("_tail") > c("_room") - half, F.concat(F.substring(c("_tail"), F.lit(1), c("_room") - half), F.lit("..."))).otherwise(c("_tail"))})
    trimmed = F.when(F.length("text") <= most // 2, F.concat("_h", "text", "_t")).otherwise(c("_wide"))
    out = F.when(F.length("_wide") > most, F.substring(trimmed, F.lit(1), F.lit(most))).otherwise(c("_wide"))
    out = F.when(F.length("text") > most, F.substring("text", F.lit(1), F.lit(most))).when(c("_room") <= 50, c("text")).otherwise(out)
    return steps.withColumn("expanded", out).select(*rows.columns, "expanded")
