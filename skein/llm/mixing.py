"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document belongs to one or more sources; its pattern is the set of them. Documents
are aggregated by pattern in Spark; the driver then routes the patterns' tokens to
the sources' quotas through a flow network whose arcs grow dearer with each
repetition, and Spark selects whole documents by a seeded hash order to meet the
flow. Only the pattern totals reach the driver, and there is a stated bound on them.

``source`` is a string, or an array of strings where a document belongs to several.

Defined results: a null text has size 0; a null source is a source of its own, sorted
last, and so is an empty or null array; an array counts as a set; documents of size 0 take 0; repeated rows count each for itself; an empty table
gives an empty result; ties in the hash order are broken by the id and size.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import WORD, id_hash, materialise, pick, repeated

SEED = "mix-1"
MAX_REPEATS = 3
#: What a token costs in its first, second and third use: convex, so that no document is repeated while an unused one can serve.
REPEAT_COST = (0, 1, 3)
#: Patterns (and sources) whose totals may go to the driver.
MAX_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(names: list[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(names, key=lambda n: (n is None, n or ""))


def pattern_of(docs: DataFrame, column: str = "source") -> Column:
    """The sources of a document as a sorted array of different ones."""
    c = F.col(f"`{column}`")
    if not isinstance(docs.schema[column].dataType, T.ArrayType):
        return F.array(c.cast("string"))
    return F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c.cast("array<string>")))).otherwise(F.array(F.lit(None).cast("string")))


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), most: int = MAX_REPEATS, total: int | None = None) -> dict[str | None, float]:
    """Token target of each source: its weight's share of all tokens, at most ``most`` times its size.

    ``total`` is all tokens, each once, where sources overlap; else the sum of the sizes.
    What a source can't take is shared again by weight among the others, until none is above its bound.
    """
    names = source_order(list(sizes))
    weight = {n: float(weights[i % len(weights)]) for i, n in enumerate(names)}
    out: dict[str | None, float] = {}
    free = list(names)
    while free:
        rest = float(sum(sizes.values()) if total is None else total) - sum(out.values())
        weights_left = sum(weight[n] for n in free)
        share = {n: rest * weight[n] / weights_left for n in free}
        over = [n for n in free if share[n] > most * sizes[n]]
        if not over:
            return out | share
        out |= {n: float(most * sizes[n]) for n in over}
        free = [n for n in free if n not in out]
    return out


def _prices(out: list[list[int]], to: list[int], room: list[int], cost: list[int], far: int) -> list[int]:
    """The cheapest path from node 0 to each node along arcs with room."""
    best, queue, waiting = [far] * len(out), deque([0]), [False] * len(out)
    best[0] = 0
    while queue:
        u = queue.popleft()
        waiting[u] = False
        for a in out[u]:
            v = to[a]
            if room[a] > 0 and best[u] + cost[a] < best[v]:
                best[v] = best[u] + cost[a]
                if not waiting[v]:
                    waiting[v] = True
                    queue.append(v)
    return best


def _levels(out: list[list[int]], to: list[int], room: list[int], cost: list[int], price: list[int]) -> list[int]:
    """Arcs from node 0 to each node along cheapest paths, -1 where there is none; it stops behind node 1's level."""
    level, layer = [-1] * len(out), [0]
    level[0] = 0
    while layer and level[1] < 0:
        new = []
        for u in layer:
            for a in out[u]:
                v = to[a]
                if level[v] < 0 and room[a] > 0 and price[u] + cost[a] == price[v]:
                    level[v] = level[u] + 1
                    new.append(v)
        layer = new
    return level


def _fill(out: list[list[int]], to: list[int], room: list[int], cost: list[int], price: list[int], level: list[int]) -> None:
    """Fills the paths to node 1 that go down one level with each arc, until each has a full arc."""
    at, path, u = [0] * len(out), [], 0
    while True:
        if u == 1:
            least = min(room[a] for a in path)
            keep = len(path)
            for i, a in enumerate(path):
                room[a] -= least
                room[a ^ 1] += least
                if not room[a] and i < keep:
                    keep = i
            u = to[path[keep] ^ 1]  # back to where the first full arc begins
            del path[keep:]
        elif at[u] < len(out[u]):
            a = out[u][at[u]]
            v = to[a]
            if room[a] > 0 and level[v] == level[u] + 1 and price[u] + cost[a] == price[v]:
                path.append(a)
                u = v
            else:
                at[u] += 1
        elif path:
            u = to[path.pop() ^ 1]
            at[u] += 1
        else:
            return


def route(patterns: list[tuple[tuple, int]], quotas: dict, most: int = MAX_REPEATS, costs: tuple[int, ...] = REPEAT_COST) -> list[int]:
    """Tokens that each pattern gives, repetitions counted.

    The source feeds each pattern by ``most`` arcs of the pattern's size with growing costs,
    a pattern feeds its sources, these the sink up to their quotas. Prices are settled one
    after the other, cheapest first: of all shortest paths of a price, those with the
    fewest arcs are filled at once by a blocking flow, until the price has no path left.
    """
    source = {m: 2 + len(patterns) + i for i, m in enumerate(quotas)}
    out: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(quotas))]
    to, room, cost = [], [], []

    def arc(u: int, v: int, cap: int, price: int) -> None:
        for a, b, c, p in ((u, v, cap, price), (v, u, 0, -price)):
            out[a].append(len(to))
            to.append(b), room.append(c), cost.append(p)

    for i, (members, size) in enumerate(patterns):
        for r in range(most):
            arc(0, 2 + i, size, costs[min(r, len(costs) - 1)])
        for m in members:
            if m in source:
                arc(2 + i, source[m], size * most, 0)
    for m, q in quotas.items():
        arc(source[m], 1, max(int(q), 0), 0)
    far = 1 << 60
    while (price := _prices(out, to, room, cost, far))[1] < far:
        while (level := _levels(out, to, room, cost, price))[1] >= 0:
            _fill(out, to, room, cost, price, level)
    # the twins of the arcs from the source hold what flows
    return [sum(room[a] for a in out[2 + i] if to[a] == 0) for i in range(len(patterns))]


def multiplicities(rows: DataFrame, key: str = "pattern", *, flow: dict, hex_digits: int = 3) -> DataFrame:
    """How often each document is taken: ``rows`` (h, doc_id, size, ``key`` array<string>, copies, ...) with ``base``, and ``extra`` copies once more.

    ``flow`` has for each pattern the tokens to take. All documents of a pattern are
    taken floor(flow / size) times; the rest goes to those that come first in the
    order of ``h``, a seeded hash of id and text. Running sums take two passes, over hash prefixes and
    within one, so that a pattern with a third of the rows isn't ordered by one task.
    The document at the border is taken if at least half of it fits.
    """
    spark = rows.sparkSession
    order = [c for c in rows.columns if c not in (key, "copies")]
    plan = spark.createDataFrame([(list(k), int(v[0]), int(v[1])) for k, v in flow.items()], T.StructType([T.StructField(key, T.ArrayType(T.StringType())), T.StructField("_flow", T.LongType()), T.StructField("_all", T.LongType())]))
    # bounded by MAX_PATTERNS, which was checked before the totals were gathered
    rows = rows.join(F.broadcast(plan), key).withColumn("_p", F.substring("h", 1, hex_digits))
    base = F.when(F.col("_all") > 0, F.floor(F.col("_flow") / F.col("_all"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("base", base).withColumn("_rest", F.col("_flow") - F.col("base") * F.col("_all"))
    sums = rows.groupBy(key, "_p").agg(F.sum(F.col("size") * F.col("copies")).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(key, "_p", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.sum(F.col("size") * F.col("copies")).over(W.partitionBy(key, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(starts, [key, "_p"]).withColumn("_at", F.col("_start") + F.coalesce(inside, F.lit(0)))
    extra = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("copies"), F.floor((F.col("_rest") - F.col("_at")) / F.col("size") + F.lit(0.5)))))
    return rows.withColumn("extra", F.coalesce(extra, F.lit(0)).cast("long"))


def solve(rows: DataFrame, key: str, *, weights=(1, 2, 3), most: int = MAX_REPEATS, bound: int = MAX_PATTERNS) -> tuple[dict, dict, dict]:
    """Source sizes, targets and the flow (pattern -> (tokens, size)) for rows with (``key``, size, copies).

    Raises ValueError where there are more patterns than ``bound``, rather than gather them.
    """
    sums = rows.groupBy(key).agg(F.sum(F.col("size") * F.col("copies")).alias("n")).limit(bound + 1).collect()
    if len(sums) > bound:
        raise ValueError(f"more than {bound} membership patterns")
    found = sorted(((tuple(r[key]), int(r["n"])) for r in sums), key=lambda x: [(m is None, m or "") for m in x[0]])
    size: dict = {}
    for members, n in found:
        for m in members:
            size[m] = size.get(m, 0) + n
    goal = targets(size, weights, most, sum(n for _, n in found))
    given = route(found, {m: int(g + 0.5) for m, g in goal.items()}, most)
    return size, goal, {p: (f, n) for (p, n), f in zip(found, given, strict=True)}


def _order(seed: str, doc_id: str, text: str) -> Column:
    return id_hash(F.lit(seed), F.col(doc_id).cast("long"), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("h")


def mix_manifest(docs: DataFrame, *, seed: str = SEED, weights=(1, 2, 3)) -> DataFrame:
    """One row per document: its size, its source's size and target (sums over its sources), and the words the mix takes of it."""
    slim = pick(docs, "doc_id", "source", "text").select(_order(seed, "doc_id", "text"), F.col("doc_id").cast("long").alias("doc_id"), pattern_of(docs).alias("pattern"), word_count(F.col("text")).alias("size"))
    rows = materialise(slim.groupBy("h", "doc_id", "size", "pattern").agg(F.count(F.lit(1)).alias("copies")), "mix")
    size, goal, flow = solve(rows, "pattern", weights=weights)
    taken = repeated(multiplicities(rows, flow=flow), "copies", "_copy")
    times = F.col("base") + F.when(F.col("_copy") < F.col("extra"), 1).otherwise(0)
    facts = rows.sparkSession.createDataFrame([(list(p), sum(size[m] for m in p), float(sum(goal[m] for m in p))) for p in flow], "pattern array<string>, source_size long, target double")
    return taken.join(F.broadcast(facts), "pattern").select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"))


def _hashable(docs: DataFrame, column: str) -> Column:
    """The column, or its JSON where it holds maps, which have no hash in Spark."""
    c, kind = F.col(f"`{column}`"), docs.schema[column].dataType
    return F.to_json(F.struct(c)) if "map<" in kind.simpleString() else c


def mix_documents(docs: DataFrame, *, seed: str = SEED, weights=(1, 2, 3)) -> DataFrame:
    """The mixed corpus: ``docs`` with every document as often as the mix takes it, same columns.

    Rows alike in all columns are decided on together; one of them stands for all. Two
    64-bit hashes with different seeds tell rows apart.
    """
    # the caller's columns travel as one, so that none of them can clash with those made here
    cells = [_hashable(docs, c) for c in docs.columns]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64(*cells).alias("row"), F.xxhash64(F.lit(seed), *cells).alias("row2"), pattern_of(docs).alias("pattern"))
    slim = rows.select(_order(seed, "doc.doc_id", "doc.text"), F.col("doc.doc_id").cast("long").alias("doc_id"), "pattern", word_count(F.col("doc.text")).alias("size"), "row", "row2")
    slim = materialise(slim.groupBy("h", "doc_id", "size", "pattern", "row", "row2").agg(F.count(F.lit(1)).alias("copies")), "mix")
    _, _, flow = solve(slim, "pattern", weights=weights)
    taken = multiplicities(slim, flow=flow)
    taken = taken.select(F.col("row").alias("_r"), F.col("row2").alias("_r2"), "copies", (F.col("base") * F.col("copies") + F.col("extra")).alias("times"))
    taken = materialise(taken.where("times > 0"), "times")
    # as many rows as documents: never a broadcast
    chosen = rows.drop("pattern").join(taken.hint("merge"), (rows["row"] == taken["_r"]) & (rows["row2"] == taken["_r2"]))
    once = chosen.where("copies = 1").unionByName(chosen.where("copies > 1").dropDuplicates(["row", "row2"]))
    return repeated(once, "times", "_k").select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
