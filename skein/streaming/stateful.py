"""Operators with state and timers of their own: sliding-window limits, leases, recent events, cached values.

Keys are dealt into BUCKETS, whose state the state store reads and writes in one piece, as each call to it costs about a
millisecond; in it each key has rows of its own. Events wait there until the watermark has passed them and are then taken
key by key in order of event time, so a result doesn't depend on the order of arrival, nor on what a micro-batch held; what
arrives behind the watermark is dropped by Spark. Timers release events, and emit rows where no event comes any more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.plans.runtime import prepare

LATE = "10 minutes"
#: Groups of keys that share a piece of state and a timer.
BUCKETS = 512
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    """State in list and value form and timers need this state store."""
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def micros(column: str = "ts"):
    return F.unix_micros(column)


class InOrder(StatefulProcessor):
    """Holds a bucket's events back until the watermark has passed them; take() then gets those of a key by (time, id), each once.

    keys: how many columns k0, k1, ... are the key (strings); after them come at (microseconds), id and what more fields
    names. A key's state is a list of rows, kept as JSON. One timer a bucket stands at its first waiting event, or at the
    first of the times that keys want to be called again.
    """

    COLUMNS: list[str] = []

    def __init__(self, keys: int, fields: str = ""):
        self.keys = keys
        names = [f"k{k}" for k in range(keys)]
        self.names = [*names, "at", "id", *[f.split()[0] for f in fields.split(", ") if f]]
        self.key_schema = ", ".join(f"{k} string" for k in names)
        self.schema = f"{self.key_schema}, at long, id long" + (f", {fields}" if fields else "")
        self.own_schema = f"{self.key_schema}, state string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.own = handle.getListState("own", self.own_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self.release(timerValues, [x for pdf in rows for x in pdf[self.names].itertuples(index=False, name=None)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.release(timerValues)

    def release(self, timerValues, new: list[tuple] = ()) -> Iterator[pd.DataFrame]:
        until, n = timerValues.getCurrentWatermarkInMs() * 1000, self.keys
        before = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due, rest = {}, []
        for x in [*before, *new]:
            due.setdefault(x[:n], []).append(x[n:]) if x[n] < until else rest.append(x)
        if rest and len(rest) == len(before) + len(new):
            self.waiting.appendList(list(new)) if new else None
        elif rest:
            self.waiting.put(rest)
        elif before:
            self.waiting.clear()
        own = {tuple(x[:n]): [tuple(row) for row in json.loads(x[n])] for x in self.own.get()} if self.own.exists() else {}
        had, out = bool(own), []
        late = [k for k, rows in own.items() if k not in due and (at := self.wake(rows)) is not None and at < until]
        for k in [*due, *late]:
            rows, found = self.take(own.get(k, []), sorted(due.get(k, [])), until)
            out += [(*k, *x) for x in found]
            if rows:
                own[k] = rows
            else:
                own.pop(k, None)
        if (due or late) and own:
            self.own.put([(*k, json.dumps(rows)) for k, rows in own.items()])
        elif had and not own:
            self.own.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        calls = [x[n] for x in rest] + [at for rows in own.values() if (at := self.wake(rows)) is not None]
        if calls:
            self.handle.registerTimer(max(min(calls) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def take(self, own: list[tuple], events: list[tuple], until: int) -> tuple[list[tuple], list[tuple]]:
        """A key's new state, none to forget it, and its result rows, of its state and next events in order (none, when it wanted to be called), up to the time until."""
        raise NotImplementedError

    def wake(self, own: list[tuple]) -> int | None:
        """When a key of this state is to be called again even without an event, in microseconds."""
        return None


def in_order(rows: DataFrame, keys: list[str], steps: InOrder, schema: str) -> DataFrame:
    """The results of steps over a stream with the columns keys, ts, at, id and more; schema has keys first."""
    names = [f"k{k}" for k in range(len(keys))]
    more = [c for c in rows.columns if c not in keys]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")
    dealt = rows.select(bucket, *[F.col(c).cast("string").alias(k) for c, k in zip(keys, names, strict=True)], *more)
    columns = [c.split() for c in schema.split(", ")]
    told = ", ".join(f"{c} string" if c in keys else f"{c} {kind}" for c, kind in columns)
    out = dealt.groupBy("bucket").transformWithStateInPandas(steps, told, "Append", "EventTime")
    return out.select(*[F.col(c).cast(kind) for c, kind in columns])


class Limiter(InOrder):
    """STR1/STR2: at most so many calls of a key in any window of so many seconds; rejected ones take up room only if count_rejected."""

    COLUMNS = ["path", "client", "event_id", "allowed"]

    def __init__(self, limit: int, seconds: int, count_rejected: bool):
        super().__init__(2)
        self.limit, self.span, self.count_rejected = limit, seconds * 1_000_000, count_rejected

    def take(self, own, events, until):
        kept, out = [x[0] for x in own], []
        for at, id_ in events:
            kept = [x for x in kept if x > at - self.span]
            ok = len(kept) < self.limit
            if ok or self.count_rejected:
                kept.append(at)
            out.append((id_, ok))
        return [(x,) for x in kept if x > until - self.span], out

    def wake(self, own) -> int | None:
        return own[-1][0] + self.span  # to forget a key that falls silent


def limited(calls: DataFrame, limit: int, seconds: int = 60, count_rejected: bool = False, late: str = LATE) -> DataFrame:
    """path, client, event_id, allowed of a stream of calls (path string, client long, event_id long, ts).

    The window is the seconds before a call, its far end left out. Times that are equal go by event_id.
    """
    with_store(calls.sparkSession)
    rows = calls.withWatermark("ts", late).select("path", "client", "ts", micros().alias("at"), F.col("event_id").alias("id"))
    return in_order(rows, ["path", "client"], Limiter(limit, seconds, count_rejected), "path string, client long, event_id long, allowed boolean")


class BothLimits(InOrder):
    """Limiter in both variants over one stream, so that events wait and timers go off once for both."""

    COLUMNS = ["path", "client", "event_id", "allowed", "allowed_of_all"]

    def __init__(self, limit: int, seconds: int):
        super().__init__(2)
        self.limit, self.span = limit, seconds * 1_000_000

    def take(self, own, events, until):
        kept, out = own, []  # every call, and whether it takes up room if rejected ones don't
        for at, id_ in events:
            kept = [x for x in kept if x[0] > at - self.span]
            ok, ok_of_all = sum(x[1] for x in kept) < self.limit, len(kept) < self.limit
            kept.append((at, ok))
            out.append((id_, ok, ok_of_all))
        return [x for x in kept if x[0] > until - self.span], out

    def wake(self, own) -> int | None:
        return own[-1][0] + self.span


def limited_both(calls: DataFrame, limit: int, seconds: int = 60, late: str = LATE) -> DataFrame:
    """path, client, event_id, allowed, allowed_of_all: limited() without and with rejected calls counted, of one reading of the stream."""
    with_store(calls.sparkSession)
    rows = calls.withWatermark("ts", late).select("path", "client", "ts", micros().alias("at"), F.col("event_id").alias("id"))
    return in_order(rows, ["path", "client"], BothLimits(limit, seconds), "path string, client long, event_id long, allowed boolean, allowed_of_all boolean")


class Leases(InOrder):
    """STR4/STR9: a lease begins with an event of kind begin, each beat (or begin) renews it, an end closes it; one not renewed within ttl seconds is lost, and a timer says so."""

    COLUMNS = ["key", "began_us", "ended_us", "status"]

    def __init__(self, ttl: int, lost: str):
        super().__init__(1, "kind string")
        self.ttl, self.lost = ttl * 1_000_000, lost

    def take(self, own, events, until):
        held, out = own[0] if own else None, []
        for at, _, kind in [*events, (until, 0, None)]:
            if held and at - held[1] > self.ttl:
                out.append((held[0], held[1] + self.ttl, self.lost))
                held = None
            if kind == "end" and held:
                out.append((held[0], at, "done"))
                held = None
            elif kind == "begin" or kind == "beat" and held:
                held = (held[0] if held else at, at)
        return [held] if held else [], out

    def wake(self, own) -> int | None:
        return own[0][1] + self.ttl


def leases(events: DataFrame, ttl: int = 300, lost: str = "orphaned", late: str = LATE) -> DataFrame:
    """key, began_us, ended_us, status (done or lost) of every lease that is over, from a stream of key long, id long, ts, kind (begin, beat, end; others mean nothing).

    lost is said once the watermark has passed the last renewal by ttl seconds, whether or not an event comes. An event at
    just that time still renews. Times that are equal go by id.
    """
    with_store(events.sparkSession)
    rows = events.withWatermark("ts", late).select("key", "ts", micros().alias("at"), "id", "kind")
    return in_order(rows, ["key"], Leases(ttl, lost), "key long, began_us long, ended_us long, status string")


class Recent(InOrder):
    """STR12: a ring of a key's last n events."""

    COLUMNS = ["key", "event_id", "held", "highest"]

    def __init__(self, n: int):
        super().__init__(1, "value double")
        self.n = n

    def take(self, own, events, until):
        ring, out = [x[0] for x in own], []
        for _, id_, value in events:
            ring = [*ring, value][-self.n :]
            known = [x for x in ring if x is not None and x == x]
            out.append((id_, len(ring), max(known, default=None)))
        return [(x,) for x in ring], out


def recent(events: DataFrame, n: int = 15, late: str = LATE) -> DataFrame:
    """key, event_id, held, highest: how many of the key's last n events there are at each event, it included, and the highest of their values (nulls and NaN aside), from a stream of key long, id long, ts, value."""
    with_store(events.sparkSession)
    rows = events.withWatermark("ts", late).select("key", "ts", micros().alias("at"), "id", "value")
    return in_order(rows, ["key"], Recent(n), "key long, event_id long, held int, highest double")


class Cached(InOrder):
    """STR3: a value is kept for ttl seconds from when it was stored; asking for it doesn't renew it."""

    COLUMNS = ["key", "event_id", "hit", "source_id"]

    def __init__(self, ttl: int):
        super().__init__(1)
        self.ttl = ttl * 1_000_000

    def take(self, own, events, until):
        held, out = own[0] if own else None, []
        for at, id_ in events:
            hit = bool(held) and at - held[0] < self.ttl
            if not hit:
                held = (at, id_)
            out.append((id_, hit, held[1]))
        return [held] if held and until - held[0] < self.ttl else [], out

    def wake(self, own) -> int | None:
        return own[0][0] + self.ttl


def cached(asked: DataFrame, ttl: int = 3600, late: str = LATE) -> DataFrame:
    """key, event_id, hit, source_id of a stream of requests (key string, id long, ts): whether the request finds a value not older than ttl seconds, and which request stored it."""
    with_store(asked.sparkSession)
    rows = asked.withWatermark("ts", late).select("key", "ts", micros().alias("at"), "id")
    return in_order(rows, ["key"], Cached(ttl), "key string, event_id long, hit boolean, source_id long")
