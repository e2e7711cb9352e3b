"""X12. Text given out by how much sound is left, with timers and state that ends.

A key's first sentence goes out at once. Later ones wait until sound has come since the last
text, none has come for a moment, and no more than ``least`` seconds are left to play;
then as many go out together as it takes to reach ``most`` characters.

Rows are (key, t, text, seconds): a sentence, or seconds of sound that arrived, at time t in
seconds. ``paced`` is a fold over such rows: the stream form keeps a key's queue in
``transformWithState``, with a timer for the time that text is due, and lets the state of
a key go ``idle`` seconds after its last row; the batch form folds the same steps over a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEAST, MOST = 5.0, 300  #: seconds of sound left, and characters sent at once
QUIET = 0.2  #: seconds without new sound after which its generation counts as ended
OUT = "key string, t double, text string"
#: Waiting sentences; when sound began, how much came, and when the last came; whether any came since the last text; whether a text went out.
STATE = "waiting array<string>, began double, sound double, last double, fresh boolean, sent boolean"
EMPTY = ([], None, 0.0, None, False, False)


def due(state: tuple, least: float, quiet: float) -> float | None:
    """The time at which the waiting text may go out, None while more sound has to come first."""
    waiting, began, sound, last, fresh, sent = state
    if not waiting:
        return None
    if not sent:
        return float("-inf")
    return max(last + quiet, began + sound - least) if fresh else None


def step(state: tuple, t: float, text: str | None, seconds: float | None) -> tuple:
    """The state after a row."""
    waiting, began, sound, last, fresh, sent = state
    if text is not None:
        return [*waiting, text], began, sound, last, fresh, sent
    if seconds is not None and seconds > 0:
        return waiting, t if began is None else began, sound + seconds, t, True, sent
    return state


def give(state: tuple, most: int) -> tuple[str, tuple]:
    """The text that goes out, and the state after it."""
    waiting, began, sound, last, _, sent = state
    n, size = 0, 0
    while n < len(waiting) and (n == 0 or sent and size < most):
        size += len(waiting[n])
        n += 1
    return " ".join(waiting[:n]), (waiting[n:], began, sound, last, False, True)


def _until(state: tuple, t: float, least: float, most: int, quiet: float) -> Iterator[tuple[float | None, str | None, tuple]]:
    """What goes out up to a time, each with its time and the state after it."""
    while (at := due(state, least, quiet)) is not None and at <= t:
        text, state = give(state, most)
        yield at, text, state


def _fold(key, rows: list[tuple], state: tuple, least: float, most: int, quiet: float) -> tuple[list[tuple], tuple]:
    out = []
    for t, text, seconds in rows:
        for at, given, state in _until(state, t, least, most, quiet):  # noqa: B020  what was due before the row came
            out.append((key, at, given))
        state = step(state, t, text, seconds)
        for at, given, state in _until(state, t, least, most, quiet):  # noqa: B020
            out.append((key, max(at, t), given))
    return out, state


def _rows(frame: pd.DataFrame) -> list[tuple]:
    none = lambda v: None if v is None or v != v else v
    return [(float(r.t), none(r.text), none(r.seconds)) for r in frame.sort_values("t", kind="stable").itertuples(index=False)]


class Pacer(StatefulProcessor):
    """One key's queue, with a timer for when its text is due."""

    def __init__(self, least: float, most: int, quiet: float, idle: float):
        self.least, self.most, self.quiet, self.idle = least, most, quiet, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pace", STATE, ttlDurationMs=int(self.idle * 1000)) if self.idle else handle.getValueState("pace", STATE)

    def _held(self) -> tuple:
        if not self.state.exists():
            return EMPTY
        waiting, *rest = self.state.get()
        return list(waiting), *rest

    def _keep(self, state: tuple) -> None:
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if (at := due(state, self.least, self.quiet)) is not None and at > float("-inf"):
            self.handle.registerTimer(int(at * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = [r for frame in rows for r in _rows(frame)]
        out, state = _fold(key[0], sorted(found, key=lambda r: r[0]), self._held(), self.least, self.most, self.quiet)
        self._keep(state)
        yield pd.DataFrame(out, columns=["key", "t", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        out, state = [], self._held()
        for at, given, state in _until(state, now, self.least, self.most, self.quiet):  # noqa: B020
            out.append((key[0], at, given))
        self._keep(state)
        yield pd.DataFrame(out, columns=["key", "t", "text"])

    def close(self) -> None:
        pass


def paced(rows: DataFrame, least: float = LEAST, most: int = MOST, quiet: float = QUIET, idle: float = 3600.0, clock: str = "ProcessingTime") -> DataFrame:
    """key, t, text: what goes out, and when.

    A stream needs the RocksDB state store. With the clock "ProcessingTime" timers follow the
    machine's clock, and t has to be its seconds; with "EventTime" they follow the watermark of
    the column ts, and no state ends by itself. At the end of a table what is still
    waiting stays unsent, as the sound that would let it go never came.
    """
    if rows.isStreaming:
        mode = clock
        return rows.groupBy("key").transformWithStateInPandas(Pacer(least, most, quiet, idle if clock == "ProcessingTime" else 0), OUT, "Append", mode)

    def whole(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out, state = _fold(group[0], _rows(frame), EMPTY, least, most, quiet)
        out += [(group[0], at, given) for at, given, state in _until(state, float("inf"), least, most, quiet)]  # noqa: B020
        return pd.DataFrame(out, columns=["key", "t", "text"])

    return rows.select(F.col("key"), "t", "text", "seconds").groupBy("key").applyInPandas(whole, OUT)
