"""Vector codes, hard negatives and approximate search against brute force, with the awkward cases in the tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import arrays
from skein.llm import cross_polytope, hard_negatives, heap_lloyd, queries

VECTORS = "vec_id long, label long, embedding array<double>"
BAD = [(9000, 1, None), (9001, 1, []), (9002, 1, [float("nan")] + [1.0] * 15), (9003, 1, [None] + [1.0] * 15), (9004, 1, [float("-inf")] + [1.0] * 15)]


def made(seed: int, n: int, dim: int = 16, hot: int = 0) -> np.ndarray:
    """Unit vectors, the first ``hot`` of them near copies of one."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[:hot] = x[0] + 0.05 * rng.standard_normal((hot, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame([(i, l, None if v is None else [None if c is None else float(c) for c in v]) for i, l, v in rows], VECTORS).repartition(parts)


# 11


def slow_codes(rows, parts, entries, rounds, scale=1024):
    """rows: (id, label, vector), all usable; plain loops over whole integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.floor(np.array(r[2]) * scale).astype("<i4").tobytes()))
    x = np.array([np.floor(np.array(r[2], float) * scale) for r in rows]).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)  # vector, part, entry
        code = d.argmin(axis=2)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    mine = x[code[:, p] == e, p]
                    if len(mine):
                        books[p, e] = mine.sum(axis=0) // len(mine)
    error = np.take_along_axis(d, code[:, :, None], 2).sum(axis=(1, 2))
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    total = {}
    for r, e in zip(rows, error, strict=True):
        total[r[1]] = total.get(r[1], 0) + int(e)
    return sorted(((r[0], "".join(f"{c:02x}" for c in k), int(e), total[r[1]], digest) for r, k, e in zip(rows, code, error, strict=True)), key=str)


@pytest.mark.parametrize(("n", "hot", "entries"), [(900, 0, 32), (900, 300, 64), (40, 0, 256), (1, 0, 256)])
def test_codes(spark, n, hot, entries):
    x = made(n + hot, n, hot=hot)
    rows = [(i, None if i % 7 == 0 else i % 3, v) for i, v in enumerate(x)]
    rows += [(5000 + i, 1, x[0]) for i in range(200 if hot else 0)]  # copies, and ties between equal entries
    rows += [rows[-1]] * 2 + [(None, 2, x[-1])]
    df = frame(spark, rows + BAD).withColumn("x", F.lit("clash")).withColumn("code", F.lit(1))
    got = heap_lloyd.compress(df, entries=entries, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_codes(rows, 4, entries, 3)


def test_codes_of_odd_tables(spark):
    assert heap_lloyd.compress(frame(spark, BAD)).collect() == []
    assert heap_lloyd.compress(frame(spark, BAD).where("false")).collect() == []
    assert heap_lloyd.compress(frame(spark, [(1, 1, [1.0] * 6)])).collect() == []  # six components have no four equal parts
    mixed = heap_lloyd.compress(frame(spark, [(1, 1, [1.0] * 8), (2, 1, [1.0] * 16), (3, 1, [0.5] * 8)]))
    assert sorted(r["vec_id"] for r in mixed.collect()) == [1, 3]
    with pytest.raises(Exception, match="after scaling"):
        heap_lloyd.compress(frame(spark, [(1, 1, [1e9] * 8)])).collect()


def test_heaps_pop_few_parts_and_lose_none(spark):
    """Clusters that settle: later passes compare a small share, and codes are those of whole comparison."""
    rng = np.random.default_rng(4)
    centres = 4 * rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.05 * rng.standard_normal((4000, 16))
    rows = [(i, i % 5, v) for i, v in enumerate(x)]
    fitted = heap_lloyd.fit(heap_lloyd.integers(frame(spark, rows)), entries=64, rounds=6)
    assert fitted.compared[0] == 16000
    assert fitted.compared[-1] < 0.35 * 16000 and fitted.compared[-1] <= fitted.compared[1]
    got = sorted((r["vec_id"], r["code"], r["error"]) for r in heap_lloyd.coded(fitted).collect())
    assert got == sorted(r[:3] for r in slow_codes(rows, 4, 64, 6))


def test_violated_parts_are_those_whose_slack_is_used_up():
    rng = np.random.default_rng(0)
    code, key, drift = rng.integers(0, 5, 500), rng.random(500) * 10, rng.random(5) * 10
    assert sorted(heap_lloyd.violated(code, key, drift)) == np.flatnonzero(key <= drift[code] + heap_lloyd.MARGIN).tolist()
    before, after = np.zeros((1, 3, 2)), np.array([[[3.0, 4.0], [0.0, 1.0], [0.0, 0.0]]])
    assert heap_lloyd.drifts(before, after).tolist() == [[6.0, 6.0, 5.0]]


# 12


def slow_negatives(rows, positives=5, negatives=10, low=30, high=90):
    best = {}
    for i, label, anchor, x in rows:
        if i is None or label is None or x is None or None in x or not x:
            continue
        flag = anchor or (i in best and best[i][2])
        if i not in best or (label, np.array(x, "<i8").tobytes()) < (best[i][0], np.array(best[i][1], "<i8").tobytes()):
            best[i] = (label, x, flag)
        best[i] = (*best[i][:2], flag)
    out = []
    for a, (label, x, anchor) in best.items():
        if not anchor:
            continue
        score = {i: sum(p * q for p, q in zip(x, v[1], strict=True)) for i, v in best.items() if len(v[1]) == len(x) and i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            inside = [i for i in order if best[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("chunk", [5, 16, 64])
def test_negatives(spark, monkeypatch, chunk):
    """Several blocks, chunks that don't divide the dimensions, one label with a third of all rows, ties and repeated rows."""
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "CELL", 2)
    rng = np.random.default_rng(chunk)
    x = rng.integers(-4, 5, (700, 16))
    x[:200] = x[0]
    x[100:200] += rng.integers(0, 2, (100, 16))
    rows = [(i, 0 if i % 3 == 0 else i % 5, i % 20 == 0, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0], rows[40], (60, 9, False, [1] * 16), (60, 0, False, [2] * 16), (900, 1, True, [1, 2]), (901, 1, None, [3, 4]), (902, 2, True, [1, 1])]
    rows += [(None, 1, True, [1] * 16), (903, None, True, [1] * 16), (904, 1, True, None), (905, 1, True, [None] * 16), (906, 1, True, []), (907, 77, True, [5] * 16)]
    df = spark.createDataFrame(rows, "id long, label long, anchor boolean, x array<long>").withColumn("g", F.lit("clash")).withColumn("raw", F.lit(0))
    got = hard_negatives.mine(df, chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == slow_negatives(rows)
    assert hard_negatives.mine(df.where("false")).collect() == []
    assert hard_negatives.mine(df.where("not anchor")).collect() == []


def test_scores_of_large_integers(spark):
    """Products beyond what a double holds exactly."""
    big = 2**29
    rows = [(1, 1, True, [big, 1]), (2, 1, False, [big, 3]), (3, 2, False, [big // 2, 1]), (4, 2, False, [big // 2, 2])]
    df = spark.createDataFrame(rows, "id long, label long, anchor boolean, x array<long>")
    assert sorted(tuple(r) for r in hard_negatives.mine(df, chunk=2).collect()) == slow_negatives(rows) != []
    over = spark.createDataFrame([(1, 1, True, [2**40, 1]), (2, 1, False, [2**40, 1])], df.schema)
    with pytest.raises(Exception, match="exceeds 64 bits"):
        hard_negatives.mine(over).collect()


# 13


def slow_search(vectors, asked, k=10):
    """{query: [(distance, id)]} of rows (id, label, vector), all usable, with no repeated ids."""
    ids, x = np.array([r[0] for r in vectors]), np.array([r[2] for r in vectors], float)
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        out[q] = sorted((float(v), int(i)) for v, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def answers(df) -> dict:
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def recall(got: dict, known: dict) -> float:
    for q, rows in got.items():
        assert rows == sorted(rows)
    return sum(len({i for _, i in known[q]} & {i for _, i in got.get(q, [])}) for q in known) / sum(len(v) for v in known.values())


def asking(df, n: int):
    return df.where(f"vec_id % {n} = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.mark.parametrize(("n", "dim", "hot"), [(3000, 32, 0), (3000, 24, 1000), (12000, 16, 4000)])
def test_search_finds_the_nearest(spark, n, dim, hot):
    """Random vectors, where neighbours are far away, and a third of all in one group."""
    x = made(n + dim, n, dim, hot)
    rows = [(i, 0, v) for i, v in enumerate(x)]
    df = frame(spark, rows)
    known, got = slow_search(rows, range(0, n, 50)), answers(cross_polytope.search(df, asking(df, 50)))
    assert recall(got, known) >= 0.9
    by = {q: dict((i, d) for d, i in slow_search(rows, [q], n)[q]) for q in list(known)[:3]}
    for q, near in by.items():
        assert len(got[q]) == 10 and all(d == pytest.approx(near[i], abs=1e-12) for d, i in got[q])


def test_search_of_odd_rows(spark, monkeypatch):
    """Copies, ties by id, unusable rows, other lengths, hot buckets in several blocks; asked whole, so that it is exact."""
    monkeypatch.setattr(cross_polytope, "BLOCK", 40)
    x = made(3, 300, 16, 100)
    x[50:90] = x[50]
    x[200:] *= np.linspace(0.2, 3, 100)[:, None]  # lengths differ: nearness isn't the angle
    rows = [(i, 0, v) for i, v in enumerate(x)]
    odd = [*BAD, (9100, 0, [0.0] * 16), (9101, 0, [1.0, 2.0]), (9102, 0, [1.0, 2.5]), (9103, 0, [4.0, 4.0]), (None, 0, x[0])]
    df = frame(spark, rows + odd + [rows[7]]).withColumn("rank", F.lit("clash")).withColumn("raw", F.lit(1)).withColumn("ids", F.lit(1))
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding")
    got = answers(cross_polytope.search(df, queries, recall=1.0))
    known = slow_search(rows, range(300))
    assert recall(got, known) >= 0.97
    assert [i for _, i in got[55]] == [50, 51, 52, 53, 54, 56, 57, 58, 59, 60] and [d for d, _ in got[55]] == [0.0] * 10
    assert [i for _, i in got[9101]] == [9102, 9103] and got[9101][0][0] == 0.5
    assert not {9000, 9001, 9002, 9003, 9004, 9100, None} & (set(got) | {i for v in got.values() for _, i in v})
    assert cross_polytope.search(df.where("false"), queries).collect() == []
    assert cross_polytope.search(df, queries.where("false")).collect() == []
    assert cross_polytope.search(df.where("vec_id = 7"), queries.where("query_id = 7")).collect() == []


def test_rotations_and_probes():
    x = made(1, 40, 24)
    for part in range(2):
        y = cross_polytope.rotated(x, 3, part)
        assert np.allclose(y @ y.T, x @ x.T) and y.shape == (40, 32)
    for shape in ((32,), (32, 4), (32, 8, 2)):
        every = int(np.prod([2 * d for d in shape]))
        order = cross_polytope.probes(x, 0, shape, every)
        assert (np.sort(order, axis=1) == np.arange(every)).all()
        assert (order[:, 0] == cross_polytope.bucket(x, 0, shape)).all()
        assert (cross_polytope.probes(x, 0, shape, 7) == order[:, :7]).all()


def test_products_choose_and_distances_decide():
    """Near copies, whose distances are below the rounding of products."""
    rng = np.random.default_rng(2)
    v = 100 + 1e-7 * rng.standard_normal((300, 8))
    i, j, d = cross_polytope.nearest_in(v[:5], v, 10)
    for q in range(5):
        exact = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        assert sorted(d[i == q]) == sorted(exact)[:10] and set(j[i == q]) == set(np.argsort(exact)[:10])


def test_queries_over_the_tables(spark):
    """The registered query over whole tables: recall against brute force."""
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], 0, r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    known = slow_search(rows, [r[0] for r in rows if r[0] % 100 == 0])
    got = answers(queries.op13_cross_polytope(spark, folder))
    assert recall(got, known) >= 0.9 and all(len(v) == 10 for v in got.values())


def test_arrow_views():
    import pyarrow as pa

    lists = pa.array([[1.0, -0.0], [2.0], [], [3.0, 4.0, 5.0]], pa.list_(pa.float64()))
    raw = arrays.packed(lists.slice(1), "<f8")
    assert arrays.lengths(raw).tolist() == [8, 0, 24]
    assert [np.frombuffer(r.as_py()).tolist() for r in raw] == [[2.0], [], [3.0, 4.0, 5.0]]
    assert np.signbit(np.frombuffer(arrays.packed(lists.slice(0, 1), "<f8")[0].as_py())).tolist() == [False, False]
    m = arrays.rows_of(np.arange(6, dtype="<i4").reshape(3, 2))
    assert arrays.matrix(m.slice(1), "<i4").tolist() == [[2, 3], [4, 5]]
