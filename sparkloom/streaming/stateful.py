"""Queues, leases and a two-phase outbox as state machines with timers.

A machine is a plain object: what a row does to the state of its key, when the state falls due,
and what happens then.  Two runners drive it in order of event time: ``streamed`` on Structured
Streaming, with the rows that the watermark has not passed yet in list state, the machine's
state in value state and a timer for the next thing to happen; and ``replayed`` on a static
table, sorted by key and time, a row at a time.  As rows wait for the watermark, what a stream
emits does not depend on how its input was cut into batches, or on restarts between them, and
equals the replay up to the watermark.

Rows of the same time are taken in order of their remaining columns.  At equal times what
falls due comes before a new row.  Rows later than the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..tables import partitions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOREVER = 1 << 62


class Coalescing:
    """Jobs of a key wait until they are due; a request for a key that waits is no job of its own
    but may put it off: the first request's id stays, the latest time to run counts.

    Rows: ``key, at, id, delay_ms``."""

    columns = "id string, delay_ms long"
    state = "id string, asked long, due long, requests long"
    output = "id string, requested_at long, run_after long, requests long"
    times = ("requested_at", "run_after")

    def row(self, state, at, id, delay_ms):
        due = at + int(delay_ms)
        return ((id, at, due, 1) if state is None else (state[0], state[1], max(state[2], due), state[3] + 1)), []

    def due(self, state):
        return state[2]

    def expire(self, state, now):
        return None, [(state[0], state[1], state[2], state[3])]


class Leases:
    """A client lives as long as a heartbeat comes before its lease is over.

    Rows: ``key, at``."""

    columns = ""
    state = "since long, due long, beats long"
    output = "since long, expires long, beats long"
    times = ("since", "expires")

    def __init__(self, ttl_ms: int = 20_000):
        self.ttl = ttl_ms

    def row(self, state, at):
        return ((at, at + self.ttl, 1) if state is None else (state[0], at + self.ttl, state[2] + 1)), []

    def due(self, state):
        return state[1]

    def expire(self, state, now):
        return None, [(state[0], state[1], state[2])]


class Outbox:
    """Each event (a key) is to be delivered and to be indexed: two phases, independent of each
    other, each handed out under a claim.  A claim that is neither done nor failed when it ends
    is handed out again, one that failed at the next ``retry``; delivery is handed out first, and
    index once delivery has been tried.  An event is forgotten when both are done.

    Rows: ``key, at, op``: ``pending``, ``<phase> done`` or ``<phase> failed``.  Emits every claim,
    and ``complete``.  A second ``pending`` of an event in the box changes nothing."""

    columns = "op string"
    state = "delivered boolean, deliver_due long, deliver_tries long, indexed boolean, index_due long, index_tries long"
    output = "phase string, attempt long, claimed_at long, claimed_until long"
    times = ("claimed_at", "claimed_until")

    def __init__(self, lease_ms: int = 300_000, retry_ms: int = 60_000):
        self.lease, self.retry = lease_ms, retry_ms

    def _claim(self, state, phase, now):
        i = 0 if phase == "deliver" else 3
        new = list(state)
        new[i + 1], new[i + 2] = now + self.lease, state[i + 2] + 1
        return tuple(new), [(phase, new[i + 2], now, now + self.lease)]

    def row(self, state, at, op):
        if state is None:
            return self._claim((False, FOREVER, 0, False, FOREVER, 0), "deliver", at) if op == "pending" else (None, [])
        phase, _, what = (op or "").partition(" ")
        i = {"deliver": 0, "index": 3}.get(phase)
        # only a claim that was handed out can be done or fail
        if i is None or what not in ("done", "failed") or not state[i + 2] or state[i]:
            return state, []
        new = list(state)
        new[i], new[i + 1] = what == "done", FOREVER if what == "done" else at + self.retry
        if new[0] and new[3]:
            return None, [("complete", new[2] + new[5], at, None)]
        if phase == "deliver" and not new[5]:
            return self._claim(tuple(new), "index", at)
        return tuple(new), []

    def due(self, state):
        return min(state[1], state[4])

    def expire(self, state, now):
        phase = "deliver" if state[1] <= state[4] else "index"
        state, out = self._claim(state, phase, now)
        # delivery that was tried without an answer lets the index begin
        if phase == "deliver" and not state[5]:
            state, more = self._claim(state, "index", now)
            out += more
        return state, out


def _advance(machine, state, until: int, out: list):
    """Everything that falls due up to ``until``."""
    while state is not None and machine.due(state) <= until:
        state, rows = machine.expire(state, machine.due(state))
        out += rows
    return state


#: Columns of machines are of these types.  Workers have no session to parse a schema with.
TYPES = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType()}


def _struct(columns: str) -> T.StructType:
    pairs = [c.split() for c in columns.split(",") if c.strip()]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


def _names(columns: str) -> list[str]:
    return _struct(columns).names


class _Processor(StatefulProcessor):
    def __init__(self, machine):
        self.machine = machine

    def init(self, handle) -> None:
        self.handle = handle
        self.columns, self.fields = _names(self.machine.columns), _names(self.machine.state)
        self.held = handle.getValueState("held", _struct(self.machine.state))
        self.waiting = handle.getListState("waiting", _struct("at long, " + self.machine.columns))
        self.timer = handle.getValueState("timer", _struct("at long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for df in rows:
            new += list(zip(df["ms"].tolist(), *[df[c].tolist() for c in self.columns]))
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, machine, out = timerValues.getCurrentWatermarkInMs(), self.machine, []
        self.timer.clear()
        state = self.held.get() if self.held.exists() else None
        state = tuple(state) if state is not None else None
        rows = sorted((tuple(r) for r in self.waiting.get()), key=_order) if self.waiting.exists() else []
        for row in rows:
            if row[0] <= now:
                state = _advance(machine, state, row[0], out)
                state, more = machine.row(state, *row)
                out += more
        state = _advance(machine, state, now, out)
        later = [r for r in rows if r[0] > now]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        if state is None:
            self.held.clear()
        else:
            self.held.update(state)
        following = [r[0] for r in later] + ([machine.due(state)] if state is not None and machine.due(state) < FOREVER else [])
        if following:
            self._wake(min(following))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *_names(machine.output)])

    def _wake(self, at: int) -> None:
        """One timer a key: the earliest thing to happen."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is None or at < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def _order(row: tuple):
    return row[0], [(x is not None, x) for x in row[1:]]


def _schema(df: DataFrame, machine) -> T.StructType:
    kind = df.schema["key"].dataType
    return T.StructType([T.StructField("key", kind), *_struct(machine.output).fields])


def _timed(df: DataFrame, machine) -> DataFrame:
    """Machines count in milliseconds, which have no time zone."""
    return df.withColumns({c: F.timestamp_millis(c) for c in machine.times})


def streamed(rows: DataFrame, machine, late: str = "10 minutes") -> DataFrame:
    """What the machine emits for a stream of ``key, at`` (a timestamp) and its columns."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        # the only store with timers and several states for a key
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    e = rows.withWatermark("at", late).select("key", "at", F.unix_millis("at").alias("ms"), *_names(machine.columns))
    out = e.groupBy("key").transformWithStateInPandas(statefulProcessor=_Processor(machine), outputStructType=_schema(rows, machine), outputMode="Append", timeMode="EventTime")
    return _timed(out, machine)


def _replay(machine, until: int):
    columns = _names(machine.columns)

    def run(frames):
        key, state, out = None, None, []
        none = object()
        key = none
        for df in frames:
            for k, at, *rest in zip(df["key"].tolist(), df["ms"].tolist(), *[df[c].tolist() for c in columns]):
                k = None if k is None or k != k else k
                if k != key:
                    more: list = []
                    _advance(machine, state, until, more)
                    out += [(key, *r) for r in more]
                    key, state = k, None
                more = []
                state = _advance(machine, state, at, more)
                state, now = machine.row(state, at, *rest)
                out += [(key, *r) for r in more + now]
            yield pd.DataFrame(out, columns=["key", *_names(machine.output)])
            out = []
        more = []
        _advance(machine, state, until, more)
        yield pd.DataFrame([(key, *r) for r in more], columns=["key", *_names(machine.output)])

    return run


def replayed(rows: DataFrame, machine, until) -> DataFrame:
    """The same for a static table: rows up to ``until`` (a timestamp, as text or datetime), and what
    falls due up to then.  Rows of a key go by one at a time, in order; none are gathered."""
    spark = rows.sparkSession
    columns = _names(machine.columns)
    limit = spark.range(1).select(F.unix_millis(F.lit(until).cast("timestamp"))).first()[0]
    e = rows.select("key", F.unix_millis("at").alias("ms"), *columns).filter(F.col("ms") <= limit)
    e = e.repartition(partitions(spark), "key").sortWithinPartitions("key", "ms", *columns)
    return _timed(e.mapInPandas(_replay(machine, limit), _schema(rows, machine)), machine)
