"""Packing by concatenate and cut.

Pass one turns every document into token ids, in place, and gives each row its offset
within its task. The tasks' token totals are summed, their prefix sums give every
task its global offset, and pass two cuts the stream at multiples of the sequence
length; a document that crosses a border becomes pieces. The ids are kept in a
written table between the passes, so that nothing is tokenised twice and the order
of rows is fixed.

Defined results: a null text is empty and still has its end token; repeated rows are
packed each for itself; an empty table gives an empty result; only the last sequence
can have padding.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import materialise, pick

LENGTH = 4096
END_ID = 2
#: Words whose ids a worker remembers in each of two generations, and the longest of these: some 130 MB, kept between tasks.
REMEMBERED, LONGEST = 300_000, 48
#: Text that is encoded at once; its arrays take some ten times as much.
BLOCK_BYTES = 12 << 20
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Letters that stand for bytes in byte-level tokenizers: printable bytes for themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_letters()


class WordEncoder:
    """Ids of texts in 16 bits, through a memory of words.

    The tokenizer never joins across white space, so that a text's ids are those of its
    words in order. Arrow splits a block of texts at ASCII white space (a subset of what
    the tokenizer splits at) and numbers the different words; only these are looked up
    or encoded, and their ids are gathered for the whole block. Words not used for two
    generations are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # a tokenizer may have another pipeline than letters | digit | symbols; then words are encoded as they are
        self.plain = [i for w in ("word", ".") for i in self._ids([w])[0]] == self._ids(["word."])[0] and self._ids(["Word", "Été"]) == [list(map(int, np.frombuffer(self._letters(w), "<u2"))) for w in ("word", "été")]

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Ids of one run of letters in lower case: only the merges are left to do."""
        return array("H", [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of new words. A word that ends in a letter and one mark of punctuation is the word and the mark."""
        parts, cores, simple = [], {}, set()
        young, old = self.young.get, self.old.get
        for s in words:
            # a letter that changes into one with a loose accent would make one run of symbols with the mark
            ends = self.plain and len(s) > 1 and s[-1] in ".,;:!?" and unicodedata.normalize("NFC", s[-2]).lower()[-1].isalpha()
            mark = s[-1] if ends else ""
            core = s[: len(s) - len(mark)]
            if self.plain and core.isalpha() and (core.isascii() or self._simple(core)):
                core = core.lower()
                simple.add(core)
            parts.append((core, mark))
            for x in (core, mark):
                if x not in cores:
                    cores[x] = young(x) or old(x)
        cores[""] = b""
        rest = []
        for s, ids in cores.items():
            if ids is None and s in simple:
                cores[s] = self._letters(s)
            elif ids is None:
                rest.append(s)
        cores.update((s, np.array(i, "<u2").tobytes()) for s, i in zip(rest, self._ids(rest), strict=True))
        return [cores[c] + cores[m] for c, m in parts]

    @staticmethod
    def _simple(word: str) -> bool:
        """Whether composing and lower-casing letters one by one changes each into one letter."""
        return unicodedata.is_normalized("NFC", word) and len(word.lower()) == len(word) and "\u03a3" not in word and word.lower().isalpha()

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        ids = list(map(self.young.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        older = list(map(self.old.get, [words[i] for i in unknown]))
        new = [i for i, x in zip(unknown, older, strict=True) if x is None]
        for i, x in zip(unknown, older, strict=True):
            ids[i] = x
        for i, x in zip(new, self._encode_words([words[i] for i in new]), strict=True):
            ids[i] = x
        self.young.update((words[i], ids[i]) for i in unknown if len(words[i]) <= LONGEST)
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, 16-bit little-endian; a null is an empty text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(i) // 2 for i in ids], np.int64)
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), "<u2")
        word = coded.indices.to_numpy()
        n = size[word]
        end = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        stream = flat[np.arange(end[-1]) + np.repeat(first[word] - end[:-1], n)]
        border = split.offsets.to_numpy() - split.offsets[0].as_py()
        cut_at = end[border]
        return [stream[a:b].tobytes() for a, b in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One a worker process, for all its tasks."""
    return WordEncoder(path)


def blocks(batch: pa.RecordBatch, column: int, block_bytes: int = BLOCK_BYTES):
    """The batch in slices of about so many bytes of text, a longer text being a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(size) // block_bytes
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def tokenise(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, part (the task), at (ids before it in the task), n (ids with the end id), ids (16-bit, little-endian)."""
    path = path or tokenizer_path()
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches):
        encoder, part, at = encoder_of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in blocks(batch, 1):
                ids = [x + end for x in encoder.encode(piece.column(1))]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "at", "n", "ids"])
                at += int(n.sum())

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, part int, at long, n long, ids binary")


def offsets(tokens: DataFrame) -> DataFrame:
    """part, base: the ids before each task's first. One row a task, so that one window and a broadcast serve at any size."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(tokens: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents in the stream's windows of ``length`` ids, with their ids if asked for."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "ids")), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(length - offset, n - start)
                    piece = wide[start : start + size].tobytes()
                    rows.append((doc, start, size, zlib.crc32(piece), n, sequence, offset, *([piece] if with_ids else [])))
                    start += size
            if rows:
                kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
                names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

    placed = tokens.join(F.broadcast(offsets(tokens)), "part").select("doc_id", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    return placed.mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def sequences(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>, padding (short of ``length`` in the last one)."""
    pieces = cut(materialise(tokenise(docs, path), "tokens"), length, with_ids=True)
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # at most ``length`` pieces each
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return joined.select("sequence_id", ids.alias("ids"), (F.lit(length) - F.octet_length(ids) / 4).cast("int").alias("padding"))


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece: where in its document and in which sequence it lies, with a checksum of its ids."""
    return cut(materialise(tokenise(docs, path), "tokens"), length)
