"""Structured Streaming forms of the stream operators.

Time is event time: every windowed or stateful stream has a watermark, and rows later
than it are dropped. Keyed folds use ``applyInPandasWithState`` with small states (a
few numbers or a text buffer a key). A fold that runs for ever should get ``idle``,
after which a key's state is let go; a run over what is there must not, as a timeout
by processing time asks for one batch after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions import text as X
from skein.sources import readers, sinks

LATE = "10 minutes"


def rate_limited(events: DataFrame, most: int, key: str = "user_id", ts: str = "ts", width: str = "1 minute", late: str = LATE) -> DataFrame:
    """X7. Windows, aligned to the clock, in which a key had more than ``most`` events."""
    counted = events.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > most).select(key, F.col("w.start").alias("start"), "n")


def turns(events: DataFrame, gap: Column, key: str = "user_id", ts: str = "ts", late: str = LATE) -> DataFrame:
    """X3, X4. Turns that end when nothing comes for the event's own delay."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_texts(events: DataFrame, keys: list[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """X14, E4. The first event of each text within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _sorted_rows(batches: Iterable[pd.DataFrame], order: str) -> pd.DataFrame:
    found = list(batches)
    return pd.concat(found).sort_values(order, kind="stable") if found else pd.DataFrame()


def _stateful(rows: DataFrame, key: str, out: str, state: str, step: Callable, idle: str | None = None) -> DataFrame:
    """A keyed fold: ``step(key, rows, state)`` gives (rows out, new state); idle keys are flushed with no rows."""
    names = [c.split()[0] for c in re.split(r",\s*", out)]

    def once(group: tuple, found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(step(group[0], [found], None)[0], columns=names)

    def run(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = held.get if held.exists else None
        if held.hasTimedOut:
            held.remove()
            done, _ = step(group[0], None, before)
        else:
            done, after = step(group[0], batches, before)
            held.update(after)
            if idle:
                held.setTimeoutDuration(_millis(idle))
        yield pd.DataFrame(done, columns=names)

    if not rows.isStreaming:
        return rows.groupBy(key).applyInPandas(once, out)
    return rows.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def _millis(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def activity(samples: DataFrame, on: float = 0.5, least_on: float = 0.05, least_off: float = 0.55, idle: str | None = None) -> DataFrame:
    """X2. Starts and ends of activity in a stream of (key, t, p, dt); a key's samples come in order of their batches."""

    def step(key, batches, before):
        active, up, down = before or (False, 0.0, 0.0)
        out = []
        for r in _sorted_rows(batches or [], "t").itertuples(index=False):
            up, down = (up + r.dt, 0.0) if r.p >= on else (0.0, down + r.dt)
            if (down if active else up) >= (least_off if active else least_on) - 1e-9:
                active = not active
                out.append((key, r.t, "start" if active else "end", up if active else down))
        return out, (active, up, down)

    return _stateful(samples, "key", "key long, t double, event string, duration double", "active boolean, up double, down double", step, idle)


def throttled(samples: DataFrame, least: float = 0.1, idle: str | None = None) -> DataFrame:
    """X8. Samples (key, t) at least ``least`` seconds after the last one let through."""

    def step(key, batches, before):
        last, out = (before or (None,))[0], []
        for r in _sorted_rows(batches or [], "t").itertuples(index=False):
            if last is None or r.t - last >= least - 1e-9:
                last = r.t
                out.append((key, r.t))
        return out, (last,)

    return _stateful(samples, "key", "key long, t double", "last double", step, idle)


def transcripts(events: DataFrame, idle: str | None = None) -> DataFrame:
    """X6. Utterances from (key, seq, kind, text): finals are appended, interims only stand in; 'end' emits.

    Only blanks at the ends of an utterance go; line ends and what stands between finals stay.
    """

    def step(key, batches, before):
        done, interim = before or ("", "")
        out = []
        for r in _sorted_rows(batches or [], "seq").itertuples(index=False):
            if r.kind == "final":
                done, interim = f"{done} {r.text}", ""
            elif r.kind == "interim":
                interim = r.text
            elif r.kind == "end":
                if full := f"{done} {interim}".strip(" "):
                    out.append((key, r.seq, full))
                done = interim = ""
        return out, (done, interim)

    return _stateful(events, "key", "key long, seq long, text string", "done string, interim string", step, idle)


def _pieces(buffer: str, least: int, end: bool) -> tuple[list[str], str]:
    """Complete sentences of at least ``least`` characters, and what is held back until more comes."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+\s+", buffer):
        if m.end() - start >= least:
            out.append(buffer[start : m.end()].strip())
            start = m.end()
    rest = buffer[start:]
    if end and rest.strip():
        out.append(rest.strip())
        rest = ""
    return out, rest


def sentence_stream(chunks: DataFrame, least: int = 20, idle: str | None = None) -> DataFrame:
    """X1. Sentences from text chunks (key, seq, text); a null text ends a segment and flushes it.

    The result doesn't depend on how the text was cut into chunks.
    """

    def step(key, batches, before):
        buffer, n = before or ("", 0)
        out = []
        for r in _sorted_rows(batches or [], "seq").itertuples(index=False):
            ended = r.text is None or r.text != r.text
            found, buffer = _pieces(buffer + ("" if ended else r.text), least, ended)
            for s in found:
                out.append((key, n, s))
                n += 1
        return out, (buffer, n)

    return _stateful(chunks, "key", "key long, position long, sentence string", "buffer string, n long", step, idle)


#: What sets thoughts apart. Fixed values.
THOUGHTS = ("<think>", "</think>")


def _begun(text: str, marks: tuple[str, ...]) -> int:
    """How many characters at the end of a text may be the start of a mark."""
    return next((n for n in range(max(map(len, marks)) - 1, 0, -1) if any(m.startswith(text[-n:]) for m in marks if n <= len(text))), 0)


def without_thoughts(chunks: DataFrame, idle: str | None = None) -> DataFrame:
    """P16. Text chunks (key, seq, text) without what stands between <think> and </think>, across chunks.

    What may be the start of a mark is held back until the next chunk; a null text, or an
    idle key, gives it out.
    """

    def step(key, batches, before):
        thinking, held = before or (False, "")
        seq, out = -1, []
        rows = _sorted_rows(batches or [], "seq")
        for seq, piece in zip(rows["seq"].tolist(), rows["text"].tolist()) if len(rows) else ():
            ended = piece is None or piece != piece
            if not (held or ended or "<" in piece):  # most pieces
                out.append((key, seq, "" if thinking else piece))
                continue
            *whole, last = re.split(r"(</?think>)", held + ("" if ended else piece))
            text = ""
            for part in whole:
                if part in THOUGHTS:
                    thinking = part == THOUGHTS[0]
                elif not thinking:
                    text += part
            n = 0 if ended else _begun(last, THOUGHTS)
            held = last[len(last) - n :]
            out.append((key, seq, text + ("" if thinking else last[: len(last) - n])))
        if batches is None and held and not thinking:
            out.append((key, seq, held))
        return out, (thinking, held)

    return _stateful(chunks, "key", "key long, seq long, text string", "thinking boolean, held string", step, idle)


#: Constructs of Markdown that are whole, and what else may open one.
WHOLE = re.compile(r"!?\[[^\]]*\]\([^)]*\)|\*\*[^*]+\*\*|\*[^*]+\*|__[^_]+__|_[^_]+_|`{3,4}\S*(?=\s)|`[^`]+`|~~[^~]*~~")
OPENING = re.compile(r"[\[!*_`~]")
LEAD = re.compile(r"[\s#>+*-]*")


def _settled(line: str, fresh: bool) -> int:
    """Up to where an unfinished line can be stripped without its rest: before a blank, with no construct open."""
    masked = WHOLE.sub(lambda m: "x" * len(m.group()), line)
    open_at = OPENING.search(masked)
    at = masked.rfind(" ", 0, open_at.start() if open_at else len(line))
    least = LEAD.match(line).end() if fresh else 0
    return at if at > least else 0


def markdown_stream(chunks: DataFrame, idle: str | None = None) -> DataFrame:
    """N2. Text chunks (key, seq, text) without Markdown marks, as pieces (key, position, text); a null text ends a key's text.

    The fold only decides what is complete: whole lines, and of the last line what ends
    before a blank with no construct open. N1's expressions strip the pieces, the rules
    for line starts only where a piece begins a line. The text is the same however it
    was cut into chunks.
    """

    def step(key, batches, before):
        held, fresh, n = before or ("", True, 0)
        out = []

        def give(piece: str) -> None:
            nonlocal n
            out.append((key, n, piece, fresh))
            n += 1

        for r in _sorted_rows(batches or [], "seq").itertuples(index=False):
            ended = r.text is None or r.text != r.text
            *lines, held = (held + ("" if ended else r.text)).split("\n")
            for line in lines:
                give(line + "\n")
                fresh = True
            at = len(held) if ended else _settled(held, fresh)
            if at:
                give(held[:at])
                held, fresh = held[at:], ended
            fresh = fresh or ended
        if batches is None and held:
            give(held)
        return out, (held, fresh, n)

    pieces = _stateful(chunks, "key", "key long, position long, text string, fresh boolean", "held string, fresh boolean, n long", step, idle)
    line = F.regexp_replace("text", "\n$", "")
    plain = F.when(F.col("fresh"), X.plain_markdown(line)).otherwise(X.plain_inline(line))
    return pieces.select("key", "position", F.concat(plain, F.when(F.endswith("text", F.lit("\n")), "\n").otherwise("")).alias("text"))


def settled_files(changes: DataFrame, cooldown: str = "60 seconds", key: str = "path", ts: str = "ts", late: str = LATE) -> DataFrame:
    """X9. Changes of files (path, ts), each file once after nothing came for the cooldown: it stays pending until then."""
    found = changes.withWatermark(ts, late) if changes.isStreaming else changes
    return found.groupBy(key, F.session_window(ts, cooldown).alias("w")).agg(F.count(F.lit(1)).alias("changes"), F.max(ts).alias("last")).select(key, "changes", "last")


def upsert_into(path: str, *keys: str) -> Callable[[DataFrame, int], None]:
    """X10. A sink that replaces and adds rows by key in the newest snapshot below a path and publishes the next.

    Of a batch's rows with one key it keeps one. A batch that is run again after a
    failure gives the same rows.
    """

    def sink(batch: DataFrame, _: int) -> None:
        news = batch.dropDuplicates(list(keys))
        old = readers.snapshot(batch.sparkSession, path)
        sinks.publish(news if old is None else old.join(news.select(*keys), list(keys), "left_anti").unionByName(news), path)

    return sink


def to_sinks(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None):
    """X9, X10, X15. One stream to several sinks in each micro-batch; ``every`` paces it, None takes what is there and ends."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
