"""Exact Jaccard join of documents by their word n-grams, as a blocked sparse matrix product.

The incidence matrix of documents by n-grams is multiplied with its transpose, but only
where a link is possible. Documents with equal sets are one class. The n-grams have a
global order, those found frequent in a sample last, the rest by hash; a document's
first n - ceil(t n) + 1 of them, its prefix, must hold one that any linked document's
prefix holds too. Then:

1. Documents that share one of their ``LOWEST`` n-grams with the lowest hashes, which
   similar documents mostly do, form clusters (frequent n-grams count only where they
   are most of a document); the whole rows of a cluster are
   multiplied in blocks, which settles the pairs inside it. In a cluster of more than
   one block all members are compared with one of them first; those linked with it are
   in one component anyhow, so that only the others are compared with all.
2. The prefix columns are multiplied for all other pairs, as a self-join by column that
   sums the overlap counts; pairs already in one component or cluster, and pairs whose
   sizes differ too much, are left out. Pairs go whose count plus the most that can lie
   behind the prefixes is less than the overlap that their sizes ask for.
3. The pairs that remain are verified with their whole sets.

The sample decides on the order alone, never on which pairs are found. N-grams are
compared by 64-bit hashes.

Defined results: null texts and texts without words have an empty set and link with
nothing; texts with fewer words than n are one n-gram; repeated rows are in one class;
a doc_id that occurs with different texts is one document with all their links; a null
doc_id links with nothing and has no component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, materialise, pick
from skein.llm.components import components
from skein.llm.vectors import _roots

#: One of so many documents is looked at for frequent n-grams; found so often there, an n-gram is frequent; at most so many are kept.
SAMPLE, OFTEN, MOST_FREQUENT = 16, 3, 200_000
LOWEST = 3
#: Documents, and n-grams in them, of a cluster that one task multiplies with as many others at once.
BLOCK, BLOCK_SHINGLES = 256, 400_000
SLICE = 1024  #: documents hashed at once
COLUMNS = 4096  #: n-grams in a block of the product
TEXT_PIECE = 1 << 16  #: bytes of a text hashed at once
_B = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of mixed values of its bytes and their places, mixed again with its length.

    A value depends on byte and place without any linear rule, so that no pattern of words
    makes sums meet. Pieces of the text are hashed one behind the other, wherever they cut words.
    """
    out, lengths = [], []
    open_, at = False, 0  # whether a word goes on into this piece, and its bytes so far
    for first in range(0, len(raw), TEXT_PIECE):
        piece = raw[first : first + TEXT_PIECE]
        inside = (piece != 32) & ((piece < 9) | (piece > 13))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        goes_on = open_ and bool(inside[0])
        starts = np.flatnonzero(begins)
        if len(starts):
            # places count from the start of the own word; gaps add nothing
            own = np.repeat(starts, np.diff(starts, append=len(piece)))
            place = np.arange(starts[0], len(piece)) - own
            if goes_on:
                place[: starts[1] - starts[0] if len(starts) > 1 else len(place)] += at
            value = _mix((place.astype(np.uint64) << np.uint64(8)) + piece[starts[0] :] + np.uint64(1)) * inside[starts[0] :]
            sums = np.add.reduceat(value, starts - starts[0])
            size = np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0])
            if goes_on:
                out[-1][-1:] += sums[:1]
                lengths[-1][-1:] += size[:1]
                sums, size = sums[1:], size[1:]
            if len(sums):
                out.append(sums)
                lengths.append(size)
        open_ = bool(inside[-1])
        at = int(lengths[-1][-1]) if open_ else 0
    if not out:
        return np.zeros(0, np.uint64)
    return _mix(np.concatenate(out) + np.concatenate(lengths).astype(np.uint64) * np.uint64(_B))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word sequences; the letters A-Z count as a-z."""
    word = _words(np.frombuffer((text or "").encode().lower(), np.uint8))
    if not len(word):
        return word
    k = min(k, len(word))
    mixed = np.zeros(len(word) - k + 1, np.uint64)
    for j in range(k):
        mixed = _mix(mixed * np.uint64(_B) + word[j : len(word) - k + 1 + j] + np.uint64(k))
    return np.unique(mixed)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _late(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which n-grams of a set are frequent ones."""
    if not len(frequent):
        return np.zeros(len(s), bool)
    return frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s


def _prefix(s: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    return np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)]


def _lowest(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The n-grams that a document looks for its cluster by.

    Where at least half of its n-grams aren't frequent, those alone count, so that documents
    that share a common passage and nothing else don't meet; in one of a large group of
    copies most are frequent, and all count.
    """
    rare = s[~late]
    return (rare if 2 * len(rare) >= len(s) else s)[:LOWEST]


def _slices(batches):
    """Batches in slices, so that a worker holds the sets of few documents."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of the n-grams that are frequent in a sample of documents; only their order depends on it."""

    def count(batches):
        for piece in _slices(batches):
            found = [shingles(t, k) for t in piece.column(0).to_pylist()]
            if found:
                s, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], names=["s", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(count, "s long, n long")
    top = sample.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT)
    return np.sort(top.toArrow().column("s").to_numpy().view(np.uint64))


def signatures(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (size of its set), sig (digest of its set), prefix, lowest (the n-grams with the lowest hashes by which it looks for its cluster)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by MOST_FREQUENT

    def run(batches):
        for batch in _slices(batches):
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            late = [_late(s, sent.value) for s in sets]
            prefix = [_prefix(s, m, percent).view(np.int64) if len(s) else None for s, m in zip(sets, late, strict=True)]
            lowest = [_lowest(s, m).view(np.int64) if len(s) else None for s, m in zip(sets, late, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(lowest, pa.list_(pa.int64()))], names=["doc_id", "n", "sig", "prefix", "lowest"])

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, prefix array<long>, lowest array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep, copies, ...) with the representatives' texts, one row for each however often it is repeated.

    What is wanted grows with the corpus, so the texts are shuffled at any size.
    """
    rows = wanted.hint("merge").join(docs, wanted["rep"] == docs["doc_id"]).drop("doc_id")
    return rows.where("copies = 1").unionByName(rows.where("copies > 1").dropDuplicates([c for c in rows.columns if c != "text"])).drop("copies")


def _linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of ``a`` and ``b`` (or of ``a`` alone) are similar: the product, some columns at a time."""
    own = b is None
    sets = a if own else a + b
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    x, y = np.arange(len(a)), np.arange(len(a)) if own else np.arange(len(a), len(sets))
    overlap = np.zeros((len(x), len(y)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        m = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        m[row[at], column[at] - first] = 1
        overlap += m[x] @ m[y].T
    overlap = overlap.astype(np.int64)
    hit = 100 * overlap >= percent * (size[x][:, None] + size[y][None, :] - overlap)
    if own:
        np.fill_diagonal(hit, False)
    return hit


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _blocks(members: str, total: str):
    return F.ceil(F.greatest(F.col(members) / F.lit(BLOCK), F.col(total) / F.lit(BLOCK_SHINGLES))).cast("int")


def near_pivots(docs: DataFrame, reps: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """c, rep, n, pivot: the members of large clusters that are linked with the cluster's smallest document.

    A task gets some members behind the pivot and holds two sets at a time.
    """
    large = clusters.where(_blocks("members", "total") > 1).withColumn("blocks", _blocks("members", "total"))
    pivots = large.groupBy("c", "blocks").agg(F.min("rep").alias("rep")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wanted = large.select("c", "rep", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("x"), F.lit(1).alias("place")).unionByName(pivots.select("c", "rep", "x", F.lit(0).alias("place")))
    rows = _texts(docs, wanted.join(reps.select("rep", "copies"), "rep")).select("c", "x", "place", "rep", "text")

    def run(batches):
        at, pivot, mine = None, None, None
        for batch in batches:
            out = []
            for c, x, place, rep, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                s = shingles(text, k)
                if place == 0:
                    at, pivot, mine = (c, x), rep, s
                elif at == (c, x) and _similar(mine, s, percent):
                    out.append((c, rep, len(s), pivot))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["c", "rep", "n", "pivot"])

    return rows.repartition("c", "x").sortWithinPartitions("c", "x", "place").mapInArrow(run, "c long, rep long, n long, pivot long")


def cluster_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, near: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) inside clusters that hold all their components together.

    ``clusters`` has c, rep, members, total (n-grams), ``near`` is a table of ``near_pivots``.
    Blocks of a large cluster are dealt in pairs, but for pairs of blocks of near members.
    """
    sums = near.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    flagged = clusters.join(sums, "c", "left").join(near.select("c", "rep", F.lit(True).alias("near")), ["c", "rep"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    flagged = flagged.select("c", "rep", F.coalesce("near", F.lit(False)).alias("near"), zero("m").alias("m"), zero("t").alias("t"), (F.col("members") - zero("m")).alias("fm"), (F.col("total") - zero("t")).alias("ft"))
    # far members are in the first blocks; the pivot is linked with itself, so that none may be far
    flagged = flagged.withColumn("_f", _blocks("fm", "ft")).withColumn("_n", _blocks("m", "t")).where("not near or _f > 0")
    own = F.when(F.col("near"), F.col("_f") + F.pmod(F.xxhash64("rep"), F.greatest("_n", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("_f", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("near"), F.col("_f") - 1).otherwise(F.col("_f") + F.col("_n") - 1))
    rows = _texts(docs, flagged.select("c", "rep", own.alias("_b"), others.alias("_os")).join(reps.select("rep", "copies"), "rep")).withColumn("_o", F.explode("_os"))
    rows = rows.select("c", F.least("_b", "_o").alias("x"), F.greatest("_b", "_o").alias("y"), (F.col("_b") <= F.col("_o")).alias("first"), (F.col("_b") == F.col("_o")).alias("own"), "rep", "text")

    def flush(group):
        own = group[0][4]
        a, b = [r for r in group if r[3]], [] if own else [r for r in group if not r[3]]
        if own and len(a) < 2 or not own and not (a and b):
            return None
        hit = _linked([r[6] for r in a], None if own else [r[6] for r in b], percent)
        i, j = np.nonzero(hit)
        reps = np.array([r[5] for r in a + b])
        root = _roots(len(reps), i, j if own else j + len(a))
        at = np.flatnonzero(reps != reps[root])
        return pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[root[at]])], names=["a", "b"])

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    if (done := flush(group)) is not None:
                        yield done
                    group = []
                group.append((*row[:6], shingles(row[6], k)))
        if group and (done := flush(group)) is not None:
            yield done

    return rows.repartition("c", "x", "y").sortWithinPartitions("c", "x", "y").mapInArrow(run, "a long, b long")


def candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the prefix product that their overlap counts and sizes leave possible.

    ``postings`` (s, rep, n, component, clusters) is a written table, so that a column
    that many documents share makes a skewed join, which adaptive execution splits.
    """
    l, r = postings.alias("l"), postings.alias("r")
    apart = (F.col("l.component") != F.col("r.component")) & ~F.arrays_overlap("l.clusters", "r.clusters")
    near = (100 * F.col("l.n") >= percent * F.col("r.n")) & (100 * F.col("r.n") >= percent * F.col("l.n"))
    pairs = l.join(r, (F.col("l.s") == F.col("r.s")) & (F.col("l.rep") < F.col("r.rep")) & apart & near)
    counted = pairs.groupBy(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), F.col("l.n").alias("na"), F.col("r.n").alias("nb")).agg(F.count(F.lit(1)).alias("c"))
    behind = F.ceil(percent * F.greatest("na", "nb") / F.lit(100)) - 1
    return counted.where((F.col("c") + behind) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs whose whole sets are similar."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "copies"), "rep")
    found = materialise(_texts(docs, asked), "asked-texts")
    one = pairs.join(found.select(F.col("rep").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    two = one.join(found.select(F.col("rep").alias("b"), "text").hint("merge"), "b").select("a", "b", "ta", "text")

    def run(batches):
        for batch in batches:
            out, last = [], (None, None)
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != a:
                    last = (a, shingles(ta, k))
                if _similar(last[1], shingles(tb, k), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = materialise(two.mapInArrow(run, "a long, b long"), "links")
    discard(found)
    return links


def groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = materialise(signatures(docs, k, percent, frequent_shingles(docs, k)), "signatures")
    usable = rows.where("sig is not null and doc_id is not null")
    reps = materialise(usable.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("lowest").alias("lowest")), "classes")
    firsts = reps.select("rep", "n", F.explode("lowest").alias("s"))
    sized = materialise(firsts.groupBy("s").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).where("members > 1"), "sized")
    mine = materialise(firsts.join(sized, "s").select(F.col("s").alias("c"), "rep", "members", "total"), "clusters")
    near = materialise(near_pivots(docs, reps, mine, k, percent), "near")
    edges = cluster_links(docs, reps, mine, near, k, percent).unionByName(near.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    edges = materialise(edges, "cluster-links")
    discard(near)
    label = components(edges)
    inside = mine.groupBy(F.col("rep").alias("_r")).agg(F.collect_list("c").alias("clusters"))  # at most LOWEST a document
    known = reps.select("rep", "n", "prefix").join(label, F.col("rep") == F.col("node"), "left").join(inside, F.col("rep") == F.col("_r"), "left")
    postings = known.select(F.explode("prefix").alias("s"), "rep", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("clusters", F.array().cast("array<bigint>")).alias("clusters"))
    postings = materialise(postings, "postings")
    discard(mine)
    pairs = materialise(candidates(postings, percent), "pairs")
    discard(postings)
    more = verified(docs, reps, pairs, k, percent)
    discard(pairs)
    final = components(edges.unionByName(more))
    found = reps.select("sig", "rep").join(final, F.col("rep") == F.col("node"), "left")
    found = materialise(found.select(F.col("sig").alias("_sig"), F.coalesce("component", "rep").alias("_c")), "found")
    for table in (reps, sized, edges, more):
        discard(table)
    done = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")).join(found, F.col("sig") == F.col("_sig"), "left")
    return done.select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))
