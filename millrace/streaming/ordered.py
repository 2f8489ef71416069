"""Streams in order of event time: rows wait until the watermark has passed them, then go through a key's state one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MS = 1000


class InOrder(StatefulProcessor):
    """Rows (t in seconds, item) of a key in order of time, then item, whatever triggers and order they come in.

    first() makes a key's state, step(state, t, item) takes a row and gives output rows. wait(state) is the time at which
    quiet(state, t) is called if no row comes before, or None. State is one value a key: the rows that wait, and the step's.
    """

    #: Columns of the output rows, beside the key.
    names: list[str] = []

    def __init__(self, fields: list[str], kinds: str, first: Callable[[], dict], step, wait=None, quiet=None):
        self.fields, self.kinds, self.first, self.step, self.wait, self.quiet = fields, kinds, first, step, wait, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"times array<bigint>, items array<bigint>, due bigint, {self.kinds}")

    def _load(self) -> tuple[list[tuple[int, int]], int | None, dict]:
        if not self.state.exists():
            return [], None, self.first()
        held = self.state.get()
        return list(zip(held[0], held[1])), held[2], dict(zip(self.fields, held[3:]))

    def _keep(self, waiting: list[tuple[int, int]], due: int | None, state: dict) -> None:
        """One timer a key: for the first row that waits, or for quiet."""
        want = min([t for t in (waiting[0][0] if waiting else None, self.wait(state) if self.wait else None) if t is not None], default=None)
        if want != due:
            if due is not None:
                self.handle.deleteTimer(due * _MS)
            if want is not None:
                self.handle.registerTimer(want * _MS)
        self.state.update(([t for t, _ in waiting], [i for _, i in waiting], want, *(state[f] for f in self.fields)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, due, state = self._load()
        waiting = sorted([*waiting, *((r["t"], r["item"]) for r in rows)])
        self._keep(waiting, due, state)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting, due, state = self._load()
        passed = timerValues.getCurrentWatermarkInMs() // _MS
        out: list[tuple] = []

        def silent(until: int) -> None:
            while self.wait and (at := self.wait(state)) is not None and at <= until:
                out.extend(self.quiet(state, at))

        done = 0
        for t, item in waiting:
            if t > passed:
                break
            silent(t - 1)
            out.extend(self.step(state, t, item))
            done += 1
        silent(passed)
        self._keep(waiting[done:], None if due is not None and due * _MS <= expiredTimerInfo.getExpiryTimeInMs() else due, state)
        for row in out:
            yield Row(**dict(zip(["key", *self.names], (key[0], *row))))


def in_order(events: DataFrame, key: str, ts: str, item: str, lateness: str, processor: InOrder, out: str) -> DataFrame:
    """The output of a processor (key and the columns of out) over a stream of events with a timestamp, in append mode.

    Rows up to `lateness` behind the latest one are taken, later ones dropped. A row is dealt with once the watermark has
    reached it, so the last ones before the end of the input still wait. Needs the RocksDB state store, see
    with_state_store(); time zones play no part, as times are seconds since 1970.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, lateness).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_seconds(ts).alias("t"), F.col(item).cast("long").alias("item"))
    processor.names = [c.split()[0] for c in out.split(", ")]
    found = rows.groupBy("key").transformWithState(processor, f"key {kind}, {out}", "Append", "EventTime")
    return found.withColumnRenamed("key", key)


def with_state_store(spark: SparkSession) -> None:
    """Lets this session's streams keep state in RocksDB, whose size is bounded by disk and not by memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def alert_timeline(events: DataFrame, key: str, ts: str, item: str, lateness: str, silence_s: int, cooldown_s: int) -> DataFrame:
    """Alerts over time: key, at (seconds), what, n.

    An event opens an alert if none is open; each further one refreshes it; it is resolved when silence_s have gone by
    without an event (n: its events). An event pages, if the last page is at least cooldown_s ago.
    """

    def step(s: dict, t: int, item: int) -> list[tuple]:
        out = []
        if s["n"] == 0:
            out.append((t, "opened", 1))
        s["n"] += 1
        s["last"] = t
        if s["paged"] is None or t - s["paged"] >= cooldown_s:
            s["paged"] = t
            out.append((t, "paged", s["n"]))
        return out

    def quiet(s: dict, at: int) -> list[tuple]:
        n, s["n"] = s["n"], 0
        return [(at, "resolved", n)]

    wait = lambda s: s["last"] + silence_s if s["n"] else None
    first = lambda: {"n": 0, "last": None, "paged": None}
    return in_order(events, key, ts, item, lateness, InOrder(["n", "last", "paged"], "n bigint, last bigint, paged bigint", first, step, wait, quiet), "at long, what string, n long")


def guarded(events: DataFrame, key: str, ts: str, item: str, lateness: str, window_s: int, warn: int) -> DataFrame:
    """Each event with the number of its key's events in the trailing window, itself included: key, item, n, state.

    Every hit is recorded. state is warn at exactly `warn` of them, block above, else pass. Events of the same second count
    in order of item.
    """

    def step(s: dict, t: int, item: int) -> list[tuple]:
        s["hits"] = [x for x in s["hits"] if x >= t - window_s] + [t]
        n = len(s["hits"])
        return [(item, n, "block" if n > warn else "warn" if n == warn else "pass")]

    return in_order(events, key, ts, item, lateness, InOrder(["hits"], "hits array<bigint>", lambda: {"hits": []}, step), f"{item} long, n long, state string")


def limited(events: DataFrame, key: str, ts: str, item: str, lateness: str, limit: int, window_s: int) -> DataFrame:
    """Each event, accepted if fewer than limit accepted ones lie in the trailing window (its start included): key, item, accepted."""

    def step(s: dict, t: int, item: int) -> list[tuple]:
        s["held"] = [x for x in s["held"] if x >= t - window_s]
        ok = len(s["held"]) < limit
        if ok:
            s["held"] = [*s["held"], t]
        return [(item, ok)]

    return in_order(events, key, ts, item, lateness, InOrder(["held"], "held array<bigint>", lambda: {"held": []}, step), f"{item} long, accepted boolean")
