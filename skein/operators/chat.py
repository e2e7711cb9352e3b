"""Ordered conversations: windows, budgets, merges, diffs.

Everything is a window or an aggregate by conversation, so that a conversation's order
is the only thing that is sorted. What is a true fold (edit scripts, list replays)
runs by conversation in pandas.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as X

CONV, TURN = "conv_id", "turn"


def ordered(*by: str) -> W:
    return W.partitionBy(CONV).orderBy(*(by or (TURN,)))


def last_n(chats: DataFrame, n: int) -> DataFrame:
    """W3, W11. The last n items of each conversation."""
    return chats.withColumn("_r", F.row_number().over(ordered(F.desc(TURN)))).where(F.col("_r") <= n).drop("_r")


def truncated(chats: DataFrame, n: int, tool_roles: tuple[str, ...] = ("tool",)) -> DataFrame:
    """W4. The last n items, without tool items in front; then the first system message is put before them.

    It is put there even if it is among the last ones, so that it stands twice.
    Conversations of n items or less stay as they are. ``position`` orders the result.
    """
    every = W.partitionBy(CONV)
    rows = chats.withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_r", F.row_number().over(ordered(F.desc(TURN))))
    rows = rows.withColumn("_system", F.min(F.when(F.col("role") == "system", F.col(TURN))).over(every))
    short = F.col("_n") <= n
    tail = rows.where(short | (F.col("_r") <= n))
    seen = F.sum((~F.col("role").isin(*tool_roles)).cast("int")).over(ordered())
    tail = tail.withColumn("_seen", F.when(short, 1).otherwise(seen)).where("_seen > 0").withColumn("position", F.col(TURN))
    front = rows.where(~short & (F.col(TURN) == F.col("_system"))).withColumn("position", F.lit(-1).cast("long"))
    return tail.drop("_seen").unionByName(front).drop("_n", "_r", "_system")


def merged_turns(chats: DataFrame) -> DataFrame:
    """W9. Neighbouring items of one role become one, their texts joined by a blank."""
    w = ordered()
    rows = chats.withColumn("_new", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    texts = F.array_sort(F.collect_list(F.struct(TURN, "text")))
    return rows.groupBy(CONV, "_run", "role").agg(F.min(TURN).alias(TURN), F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("text")).drop("_run")


def rolling_budget(chats: DataFrame, budget: int, marked: Column) -> DataFrame:
    """W5. Of the marked items the oldest go until the marked ones fit into the budget; whole items, so it may go below."""
    every = W.partitionBy(CONV)
    n = F.when(marked, X.tokens(F.col("text"))).otherwise(0)
    rows = chats.withColumn("_n", n).withColumn("_over", F.sum("_n").over(every) - budget)
    before = F.sum("_n").over(ordered()) - F.col("_n")
    return rows.withColumn("_gone", marked & (before < F.col("_over"))).where("not _gone").drop("_n", "_over", "_gone")


def within_words(chats: DataFrame, limit: int) -> DataFrame:
    """W23. The first item stays; of the others the oldest go until all fit into ``limit`` words."""
    rows = chats.withColumn("_n", F.size(F.split(X.strip(F.col("text")), f"{X.SPACE}+"))).withColumn("_i", F.row_number().over(ordered()))
    rows = rows.withColumn("_first", F.max(F.when(F.col("_i") == 1, F.col("_n"))).over(W.partitionBy(CONV)))
    rows = rows.withColumn("_tail", F.sum("_n").over(ordered(F.desc(TURN))))
    return rows.where((F.col("_i") == 1) | (F.col("_tail") <= limit - F.col("_first"))).drop("_n", "_i", "_first", "_tail")


def without_repeats(chats: DataFrame, *columns: str) -> DataFrame:
    """W22, X14. Without items equal to the one just before."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(ordered()))
    first = F.row_number().over(ordered()) == 1
    return chats.withColumn("_same", same & ~first).where("not _same").drop("_same")


def relative_day(ts: Column, as_of: Column) -> Column:
    """W8. How long ago, in words, seen from ``as_of``."""
    days = (F.unix_micros(as_of) - F.unix_micros(ts)) / 86_400_000_000
    return F.when(days < 1, "today").when(days < 2, "yesterday").when(days < 7, F.concat(F.floor(days).cast("string"), F.lit(" days ago"))).when(days < 14, "more than a week ago").when(days < 30, "2 weeks ago").otherwise("more than a month ago")


def distinct_ignoring_case(items: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A12. The first of those that are equal but for case, in order."""
    w = W.partitionBy(key, F.lower(value)).orderBy(order)
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distinct_elements(rows: DataFrame, key: str, values: Column, value: str, order: str) -> DataFrame:
    """A12 on arrays: ``distinct_ignoring_case`` of their elements, with their places as ``order``.

    Each row's array is freed of repeats where it lies; only rows whose key occurs in several are shuffled.
    """
    several = F.broadcast(rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k"))
    same = F.col(key).eqNullSafe(F.col("_k"))

    def firsts(some: DataFrame) -> DataFrame:
        items = F.transform(values, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("i"), v.alias("v")))
        found = some.select(key, F.sort_array(items).alias("_s"))  # a column, as each element looks at the one before
        new = F.filter("_s", lambda x, i: (i == 0) | ~x["low"].eqNullSafe(F.get("_s", i - 1)["low"]))
        return found.select(key, F.explode(new).alias("_x")).select(key, F.col("_x.i").alias(order), F.col("_x.v").alias(value))

    repeated = distinct_ignoring_case(firsts(rows.join(several, same, "left_semi")), key, value, order)
    return firsts(rows.join(several, same, "left_anti")).unionByName(repeated)


def appended(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """J10. The old items and those new ones whose key isn't there yet."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def same_sequence(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """W14. Whether two versions of each conversation are equal item by item."""
    number = lambda d, p: d.withColumn("_i", F.row_number().over(ordered())).select(CONV, "_i", *(F.col(c).alias(f"{p}{c}") for c in columns), F.lit(True).alias(f"{p}here"))
    both = number(a, "a_").join(number(b, "b_"), [CONV, "_i"], "full")
    equal = F.col("a_here").eqNullSafe(F.col("b_here"))
    for c in columns:
        equal = equal & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return both.groupBy(CONV).agg(F.bool_and(equal).alias("same"))


def paired_calls(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """J9. Tool calls with their outputs; what has no partner goes, on both sides."""
    return calls.join(outputs, "call_id")


def edit_script(old: DataFrame, new: DataFrame) -> DataFrame:
    """W13. The items to remove, create (behind which one) and update that turn one version into the other.

    Kept are the items of a longest common subsequence of ids. As an id stands once in a
    version (of several the first counts), that is a longest increasing run of old
    places, found in n log n steps. Conversations are compared apart, each within one task.
    """
    cols = [CONV, TURN, "id", "text"]
    both = old.select(*cols, F.lit(0).alias("side")).unionByName(new.select(*cols, F.lit(1).alias("side")))

    def run(rows):
        import pandas as pd

        rows = rows.sort_values(TURN, kind="stable").drop_duplicates(["side", "id"])
        a, b = (list(rows[rows["side"] == s][["id", "text"]].itertuples(index=False)) for s in (0, 1))
        place = {x.id: i for i, x in enumerate(a)}
        common = [place[x.id] for x in b if x.id in place]
        ends, at, before = [], [], [-1] * len(common)  # the least end of a run of each length, and where it stands
        for i, p in enumerate(common):
            n = bisect_left(ends, p)
            ends[n : n + 1], at[n : n + 1] = [p], [i]
            before[i] = at[n - 1] if n else -1
        kept, i = {}, at[-1] if at else -1
        while i >= 0:
            kept[a[common[i]].id] = a[common[i]].text
            i = before[i]
        out = [("remove", x.id, None) for x in a if x.id not in kept]
        last = None
        for x in b:
            if x.id not in kept:
                out.append(("create", x.id, last))
            elif kept[x.id] != x.text:
                out.append(("update", x.id, last))
            last = x.id
        conv = rows[CONV].iloc[0]
        return pd.DataFrame([(conv, *o) for o in out], columns=[CONV, "action", "id", "previous_id"])

    return both.groupBy(CONV).applyInPandas(run, f"{CONV} long, action string, id string, previous_id string")


def replayed(log: DataFrame) -> DataFrame:
    """W15. A list from its log of insertions (behind ``previous_id``, null for the front) and deletions, in order of ``seq``."""

    def run(rows):
        import pandas as pd

        after: dict = {None: None}
        before: dict = {}
        for r in rows.sort_values("seq").itertuples(index=False):
            if r.action == "insert" and r.id not in before and (r.previous_id in after):
                nxt = after[r.previous_id]
                after[r.previous_id], after[r.id], before[r.id] = r.id, nxt, r.previous_id
                if nxt is not None:
                    before[nxt] = r.id
            elif r.action == "delete" and r.id in before:
                nxt, prev = after.pop(r.id), before.pop(r.id)
                after[prev] = nxt
                if nxt is not None:
                    before[nxt] = prev
        out, at = [], after[None]
        while at is not None:
            out.append(at)
            at = after[at]
        return pd.DataFrame({CONV: rows[CONV].iloc[0], "position": range(len(out)), "id": out})

    return log.groupBy(CONV).applyInPandas(run, f"{CONV} long, position long, id string")


def long_enough(chats: DataFrame, least: int = 3) -> DataFrame:
    """P9. Items of at least so many characters, blanks at the ends not counted."""
    return chats.where(F.length(F.trim("text")) >= least)


def without_instructions(chats: DataFrame, roles: tuple[str, ...] = ("system", "developer")) -> DataFrame:
    """P10. Items that aren't instructions and have a text."""
    return chats.where(~F.col("role").isin(*roles) & (F.col("text") != ""))


def text_content(content: Column) -> Column:
    """P11. The text parts of an array of (kind, text), one a line; null where there is none."""
    texts = F.filter(content, lambda x: x["kind"] == "text")
    return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda x: x["text"]), "\n"))


def exported(chats: DataFrame, *excluded: str) -> DataFrame:
    """P17. Items as JSON, without those of the excluded roles."""
    return chats.where(~F.col("role").isin(*excluded)).select(F.to_json(F.struct(CONV, TURN, "role", "text")).alias("json"))


def imported(rows: DataFrame) -> DataFrame:
    """P17. The items of ``exported``."""
    return rows.select(F.from_json("json", f"{CONV} long, {TURN} long, role string, text string").alias("x")).select("x.*")


def statistics(chats: DataFrame, retrieved: Column) -> DataFrame:
    """A8. Messages, characters, tokens and retrieved tokens by role."""
    n = X.tokens(F.col("text"))
    return chats.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"), F.sum(n).alias("tokens"), F.sum(F.when(retrieved, n).otherwise(0)).alias("retrieved"))


def last_of_role(chats: DataFrame, role: str = "user") -> DataFrame:
    """W10. The last item of a role in each conversation; others are put before its turn."""
    return chats.where(F.col("role") == role).groupBy(CONV).agg(F.max(TURN).alias(TURN), F.max_by("text", TURN).alias("text"))


def placed_by(chats: DataFrame, created: str) -> DataFrame:
    """W12. Each item's position by time of creation; of equal times the later item stands behind."""
    return chats.withColumn("position", F.row_number().over(ordered(created, TURN)).cast("long"))


def headed(messages: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """W8. Whether a message's ``label`` differs from the one before, so that it gets a ``heading``."""
    return messages.withColumn("heading", ~F.col(label).eqNullSafe(F.lag(label).over(W.partitionBy(key).orderBy(*order))) | (F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1))
