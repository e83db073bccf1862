"""Live navigation: fixes are matched to their route without state; a keyed processor adds the arrival latch and announcements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.navigation import ANNOUNCE_M, ARRIVAL_M, ARRIVED, COOLDOWN_MS, REMIND_M

OUT = "rider_id long, event_id long, ts timestamp, idx int, arrived boolean, off_route boolean, said string"
STATE = "arrived boolean, last_idx int, last_ms long, seen_ms long"


def voice(m: float) -> str:
    feet = int(m * 3.281 + 0.5)
    tenths = int(m / 160.934 + 0.5)
    if m < 30:
        return "a few yards"
    if feet <= 200:
        return f"{int(feet / 10 + 0.5) * 10} feet"
    return "a tenth of a mile" if tenths <= 1 else f"{tenths} tenths of a mile"


def advance(state: tuple[bool, int, int], fix, now: int) -> tuple[tuple[bool, int, int], str | None]:
    """One fix of a rider at a millisecond: the new state (arrived, index announced last, when) and what is said."""
    arrived, last_idx, last_ms = state
    if not arrived and fix.remaining_m < ARRIVAL_M:
        return (True, last_idx, last_ms), ARRIVED
    if arrived or fix.next_text is None or pd.isna(fix.next_text):
        return state, None
    if fix.idx != last_idx and fix.to_turn_m <= ANNOUNCE_M:
        return (arrived, int(fix.idx), now), f"In {voice(fix.to_turn_m)}, {fix.next_text}"
    if fix.to_turn_m <= REMIND_M and fix.idx == last_idx and now - last_ms > COOLDOWN_MS:
        return (arrived, last_idx, now), fix.next_text
    return state, None


def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Updates of one rider in event time; fixes older than the last one are dropped. Idle riders are forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    arrived, last_idx, last_ms, seen = state.get if state.exists else (False, -1, 0, -1)
    rows = []
    for fix in pd.concat(list(pdfs)).sort_values(["ts", "event_id"]).itertuples():
        ms = int(fix.ts.value // 1_000_000)
        if ms < seen:
            continue
        seen = ms
        (arrived, last_idx, last_ms), said = advance((arrived, last_idx, last_ms), fix, ms)
        rows.append((key[0], fix.event_id, fix.ts, int(fix.idx), arrived, bool(fix.off_route), said))
    state.update((arrived, last_idx, last_ms, seen))
    state.setTimeoutDuration(3_600_000)
    if rows:
        yield pd.DataFrame(rows, columns=["rider_id", "event_id", "ts", "idx", "arrived", "off_route", "said"])


def tracked(updates: DataFrame) -> DataFrame:
    """A stream of updates (operators.navigation) as a stream of what riders see and hear; state by rider."""
    return updates.groupBy("rider_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay(updates: DataFrame) -> DataFrame:
    """The same fold over a table that is small enough for a rider's fixes to be one group; operators.navigation.announced() has no such limit."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = (False, -1, 0), []
        for fix in pdf.sort_values(["ts", "event_id"]).itertuples():
            state, said = advance(state, fix, int(fix.ts.value // 1_000_000))
            rows.append((fix.rider_id, fix.event_id, fix.ts, int(fix.idx), state[0], bool(fix.off_route), said))
        return pd.DataFrame(rows, columns=["rider_id", "event_id", "ts", "idx", "arrived", "off_route", "said"])

    return updates.groupBy("rider_id").applyInPandas(one, OUT)


def debounced(events: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last query of each burst of a stream of search events, by session windows."""
    w = events.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap))
    return w.agg(F.max_by("query", F.struct("ts", "seq")).alias("query"), F.max("ts").alias("ts")).select("session", "ts", "query")
