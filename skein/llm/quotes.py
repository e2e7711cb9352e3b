"""Chat formatting by quotation linking (native).

Quote markers give every line of a message its level. Lines of one level that follow one
another are a passage, which a blank line ends. A passage is normalised and hashed, and
so are its sentences and its lines, as a quotation may be wrapped otherwise than its
original, or hold a part of it; these parts are looked up among those that messages of
the same conversation wrote themselves, and the first message that wrote a part is its
original. A message answers the earlier message that most letters of its outermost
linked quotation come from, the later one of two with as many. Messages carry their own
words only, and their places in reply order: each below the one that it answers.

Native: columns and joins. Parts are aggregated by conversation and hash before they are
joined, so that a line that a third of the messages hold is one row. The places come
from a walk around the reply trees (into a message, through its answers, out of it),
a list in which every entry names the one before; doubling these pointers sums depths
and places in as many rounds as the longest thread has digits in binary, without paths.

Defined results: a null text is empty; messages without a linked quotation start a
thread at their own turn; a quotation of a later or unknown part links with nothing;
rows that share conversation and turn share their links and place; any long is a turn;
null conversations or turns link with nothing; an announcement ("On Monday X wrote:", up
to four lines of any length) goes with the quotation that follows it, blank lines
between; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import discard, let, materialise, pick

#: The markers before a quoted line, one a level. Groups repeat possessively, as Java's regex recurses for each repeat otherwise.
MARKS = r"^[ \t]*+((?:>[ \t]?+)++)"
#: What announces the quotation that follows; ``>`` stands for a quoted line, as no other line starts with it.
ANNOUNCED = r"(?imdu)^[ \t]*+(?:on|am|le|el)\b[^\n]*(?:\n[^\n>][^\n]*){0,3}?(?:wrote|schrieb|écrit|escribió)[ \t]?:[ \t]*+\n(?:[ \t]*+\n)*+(?=>)"
SENTENCE = r"(?<=[.!?])\s+"


def _lines(text: Column) -> Column:
    """Array of (level, body) of a text's lines."""
    line = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))
    return F.transform(F.split(text, r"\r?\n", -1), line)


def _normalised(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))


def _parts(lines: Column) -> Column:
    """Array of (level, part): each passage, its sentences and its lines, normalised."""
    blank = lambda x: F.trim(x["body"]) == ""
    before = lambda m, i: F.get(m, i - 1)
    begins = F.filter(F.transform(lines, lambda x, i: F.when(~blank(x) & ((i == 0) | (before(lines, i)["level"] != x["level"]) | blank(before(lines, i))), i)), lambda i: i.isNotNull())

    def passages(starts: Column) -> Column:
        size = lambda s, k: F.coalesce(F.get(starts, k + 1), F.size(lines)) - s
        body = lambda s, k: F.array_join(F.transform(F.slice(lines, s + 1, size(s, k)), lambda x: x["body"]), " ")
        return F.flatten(F.transform(starts, lambda s, k: let(body(s, k), lambda whole: F.transform(F.concat(F.array(whole), F.split(whole, SENTENCE)), lambda p: F.struct(F.get(lines, s)["level"].alias("level"), _normalised(p).alias("part"))))))

    return F.concat(F.transform(lines, lambda x: F.struct(x["level"].alias("level"), _normalised(x["body"]).alias("part"))), let(begins, passages))


def parse(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines, and ``own``: the words without quotations and their announcements."""
    rows = pick(chats, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), _lines(F.coalesce("text", F.lit(""))).alias("lines"))
    marked = F.array_join(F.transform("lines", lambda x: F.when(x["level"] > 0, ">").otherwise(x["body"])), "\n")
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, ANNOUNCED, ""), r"(?md)^>(?:\n|\z)", ""), r"\A\s++|(?<!\s)\s++\z", "")
    return rows.withColumn("own", F.when(F.exists("lines", lambda x: x["level"] > 0), own).otherwise(marked))


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to: the message that each one answers by its quotations."""
    known = parsed.where("conv_id is not null and turn is not null")
    parts = lambda rows: rows.select("conv_id", "turn", F.explode(_parts(F.col("lines"))).alias("p")).select("conv_id", "turn", F.col("p.level").alias("level"), F.length("p.part").alias("chars"), F.unhex(F.md5("p.part")).alias("h")).where("chars > 0")
    quotes = parts(known.where(F.exists("lines", lambda x: x["level"] > 0))).where("level > 0")
    quoted = materialise(quotes.groupBy("conv_id", "turn", "level", "h").agg(F.max("chars").alias("chars")), "quoted")
    first = parts(known).where("level = 0").groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    first = materialise(first.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi"), "origins")
    found = quoted.join(first, ["conv_id", "h"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "origin").agg(F.min("level").alias("level"), F.sum("chars").alias("chars"))
    # of equal votes the later origin: the turns are reversed by ~, which no long overflows
    best = F.min_by("origin", F.struct("level", -F.col("chars"), F.bitwise_not("origin")))
    linked = materialise(votes.groupBy("conv_id", "turn").agg(best.alias("reply_to")), "replies")
    discard(quoted)
    discard(first)
    return linked


def _siblings(linked: DataFrame) -> DataFrame:
    """``linked`` with ``left``, the answer to the same message before this one.

    Answers are sorted over all tasks; what lies in an earlier task comes from a table of
    one row a task and message, so that a message that a third of all rows answer isn't
    sorted by one task.
    """
    order = ("conv_id", "reply_to", "turn")
    dealt = materialise(linked.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "answers")
    inside = dealt.withColumn("_l", F.lag("turn").over(W.partitionBy("conv_id", "reply_to", "part").orderBy("turn")))
    ends = dealt.groupBy("conv_id", "reply_to", "part").agg(F.max("turn").alias("_e"))
    ends = ends.withColumn("_e", F.lag("_e").over(W.partitionBy("conv_id", "reply_to").orderBy("part")))
    return inside.join(ends, ["conv_id", "reply_to", "part"]).select("conv_id", "turn", "reply_to", F.coalesce("_l", "_e").alias("left"))


def places(linked: DataFrame) -> DataFrame:
    """conv_id, turn, thread_turn, reply_depth, thread_order of all messages in threads of two or more."""
    into, out = F.lit(0), F.lit(1)
    answers = materialise(_siblings(linked), "siblings")
    last = answers.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.max("turn").alias("last"))
    roots = last.select("conv_id", "turn").join(answers.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    first = answers.select("conv_id", "turn", into.alias("way"), F.coalesce("left", "reply_to").alias("p_turn"), F.when(F.col("left").isNull(), into).otherwise(out).alias("p_way"))
    first = first.unionByName(roots.select("conv_id", "turn", into.alias("way"), F.lit(None).cast("long").alias("p_turn"), F.lit(None).cast("int").alias("p_way")))
    second = first.select("conv_id", "turn").join(last, ["conv_id", "turn"], "left")
    second = second.select("conv_id", "turn", out.alias("way"), F.coalesce("last", "turn").alias("p_turn"), F.when(F.col("last").isNull(), into).otherwise(out).alias("p_way"))
    # sums over the entries from the pointed-to one up to the one before: entered, still open
    walk = first.unionByName(second).withColumns({"n": F.when(F.col("p_turn").isNotNull(), 1 - F.col("p_way")).otherwise(0).cast("long"), "d": F.when(F.col("p_turn").isNotNull(), 1 - 2 * F.col("p_way")).otherwise(0).cast("long"), "start": F.coalesce("p_turn", "turn")})
    walk = materialise(walk, "walk")
    while walk.where("p_turn is not null").limit(1).count():
        up = walk.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("way").alias("_w"), F.col("p_turn").alias("_pt"), F.col("p_way").alias("_pw"), F.col("n").alias("_n"), F.col("d").alias("_d"), F.col("start").alias("_s"))
        step = walk.join(up, (F.col("conv_id") == F.col("_c")) & (F.col("p_turn") == F.col("_t")) & (F.col("p_way") == F.col("_w")), "left")
        add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
        new = materialise(step.select("conv_id", "turn", "way", F.col("_pt").alias("p_turn"), F.col("_pw").alias("p_way"), add("n", "_n").alias("n"), add("d", "_d").alias("d"), F.coalesce("_s", "start").alias("start")), "walk")
        discard(walk)
        walk = new
    return walk.where("way = 0").select("conv_id", "turn", F.col("start").alias("thread_turn"), F.col("d").alias("reply_depth"), F.col("n").alias("thread_order"))


def conversations(chats: DataFrame) -> DataFrame:
    """Every message with its own words, what it answers, and its place in reply order.

    ``thread_turn`` is the first message of the thread, ``reply_depth`` the number of
    answers from there, ``thread_order`` the place in the thread. Sorted by thread and
    place, a conversation has each message below the one that it answers.
    """
    parsed = parse(chats)
    linked = links(parsed)
    way = linked.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "reply_to")
    if linked.limit(1).count():
        way = materialise(places(linked), "places").withColumnsRenamed({"conv_id": "_c", "turn": "_t"}).join(way, ["_c", "_t"], "left")
    else:
        way = way.withColumns({c: F.lit(None).cast("long") for c in ("thread_turn", "reply_depth", "thread_order")})
    rows = parsed.join(materialise(way, "ways"), (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    levels = F.transform("lines", lambda x: x["level"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size(F.filter(levels, lambda x: x > 0)).cast("long").alias("n_quoted"), F.coalesce(F.array_max(levels), F.lit(0)).cast("long").alias("quote_level"), "reply_to", F.coalesce("thread_turn", "turn").alias("thread_turn"), zero("reply_depth"), zero("thread_order"))
