"""The whole live stream: raw fixes beside their route, then one keyed processor with timers, and the rows that are no fixes.

    good, bad = live.sorted_out(events)
    said = live.followed(good, routes, instructions, facts)

events: rider_id, event_id, ts, kind (fix, stop, or error), route_id, lat, lng, message. Matching to the route is stateless; the processor keeps a rider's arrival latch,
announcements and off-route banner in event time, whose timers run when the watermark passes them, so the same events give the same
results in whatever batches they come. `follow` is the fold itself, on plain values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import navigation
from .navigation import advance

OUT = "rider_id long, kind string, ms long, event_id long, idx int, arrived boolean, off_route boolean, said string"
_OUT = Row(*(c.split()[0] for c in OUT.split(", ")))
#: A rider without a fix for so long is forgotten.
IDLE_MS = 3_600_000


class State(NamedTuple):
    arrived: bool = False
    last_idx: int = -1
    last_ms: int = 0
    seen_ms: int = -1
    banner: bool = False
    hide_ms: int = -1  # when the banner goes; -1: no timer runs

    def due(self) -> int:
        """When the next timer runs out."""
        return self.hide_ms if self.hide_ms >= 0 else self.seen_ms + IDLE_MS


STATE = "arrived boolean, last_idx int, last_ms long, seen_ms long, banner boolean, hide_ms long"
Out = tuple[Any, ...]


def expired(state: State, now: int) -> tuple[State | None, list[Out]]:
    """The state at a millisecond, after its timers; None: forgotten."""
    out: list[Out] = []
    if 0 <= state.hide_ms <= now:
        out.append(("hidden", state.hide_ms, None, None, state.arrived, None, None))
        state = state._replace(banner=False, hide_ms=-1)
    return (None if state.seen_ms + IDLE_MS <= now else state), out


def follow(state: State | None, events: Iterable) -> tuple[State | None, list[Out]]:
    """Events of one rider in event time; those older than the last one seen are dropped, a stop forgets the rider."""
    out: list[Out] = []
    for e in sorted(events, key=lambda e: (e.ms, e.event_id)):
        if state is not None:
            if e.ms < state.seen_ms:
                continue
            state, gone = expired(state, e.ms)
            out += gone
        if e.kind == "stop":
            if state is not None:
                out.append(("stopped", e.ms, e.event_id, None, state.arrived, None, None))
            state = None
            continue
        state = state or State()
        (arrived, last_idx, last_ms), said = advance((state.arrived, state.last_idx, state.last_ms), e, e.ms)
        if e.off_route and not state.banner:
            out.append(("shown", e.ms, e.event_id, None, arrived, True, None))
        banner = state.banner or e.off_route
        state = State(arrived, last_idx, last_ms, e.ms, banner, e.ms + navigation.BANNER_MS if banner and not e.off_route else -1)
        out.append(("update", e.ms, e.event_id, e.idx, arrived, e.off_route, said))
    return state, out


class Follower(StatefulProcessor):
    """One rider's state and its next timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rider", STATE)

    def known(self) -> State | None:
        return State(*self.state.get()) if self.state.exists() else None

    def keep(self, state: State | None) -> None:
        """The new state, and of timers the one that is due next."""
        for at in list(self.handle.listTimers()):
            if state is None or at != state.due():
                self.handle.deleteTimer(at)
        if state is None:
            self.state.clear()
        else:
            self.state.update(tuple(state))
            self.handle.registerTimer(state.due())

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state, out = follow(self.known(), list(rows))
        self.keep(state)
        yield from (_OUT(key[0], *o) for o in out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self.known()
        if state is not None:
            state, out = expired(state, expiredTimerInfo.getExpiryTimeInMs())
            self.keep(state)
            yield from (_OUT(key[0], *o) for o in out)

    def close(self) -> None:
        pass


def sorted_out(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixes and stops that can be worked on; and all other rows with the reason, for a sink of their own."""
    c = F.col
    off = lambda x, most: c(x).isNull() | F.isnan(x) | (F.abs(c(x)) > most)
    reason = (
        F.when(c("kind") == "error", F.coalesce("message", F.lit("position error"))).when(~F.coalesce(c("kind").isin("fix", "stop"), F.lit(False)), "unknown kind")
        .when(c("rider_id").isNull() | c("event_id").isNull() | c("ts").isNull(), "no rider, number or time").when((c("kind") == "fix") & (off("lat", 90) | off("lng", 180)), "no position")
        .when((c("kind") == "fix") & c("route_id").isNull(), "no route")
    )
    seen = events.withColumn("reason", reason)
    return seen.where("reason is null").drop("reason"), seen.where("reason is not null").select("rider_id", "event_id", "ts", "kind", "reason")


def beside_routes(events: DataFrame, routes: DataFrame, instructions: DataFrame, facts: DataFrame) -> DataFrame:
    """Events with what their route says of them; no row is kept in state for it. Fixes on a route that is not there are left out.

    routes: route_id, segments (operators.navigation.routes_of). instructions, facts: as for operators.navigation.updates.
    """
    known = routes.select("route_id", "segments").join(instructions, "route_id").join(facts.select("route_id", F.col("distance").alias("route_m"), F.col("time").alias("route_s")), "route_id")
    rows = events.select("rider_id", "event_id", "ts", "kind", "route_id", "lat", "lng").join(known, "route_id", "left").where("kind = 'stop' or segments is not null")
    out = navigation.progress(navigation.placed(rows))
    return out.select("rider_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), "kind", "idx", "next_text", "to_turn_m", "remaining_m", "off_route")


def followed(events: DataFrame, routes: DataFrame, instructions: DataFrame, facts: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of events as a stream of OUT: updates with what is said, banners shown and hidden, stops."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = beside_routes(events.withWatermark("ts", late), routes, instructions, facts)
    return rows.groupBy("rider_id").transformWithState(statefulProcessor=Follower(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
