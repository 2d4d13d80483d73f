"""Request guards and metrics over event streams (W1-W6), with batch twins.

A batch twin passes over the history of a key in order. A stream runs on event
time: rows wait in a key's state until the watermark has passed them, a timer
fires, and they are decided in order, so that results equal the batch twin's
whatever the order of arrival. Rows that arrive behind the watermark are dropped
and counted by Spark (``numRowsDroppedByWatermark``); rows without a time are
dropped as well. A second timer clears the state of a key when it has lapsed, that
is, when it has become what a key without a history has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pactlake.operators.rubric import score_documents

# --- fixed values -------------------------------------------------------------------------------
CAPACITY, PER_MINUTE = 12, 4.0
DEDUP_MINUTES, RATE_LIMITED_MINUTES, RETIRED_MINUTES, REDEEM_MINUTES = 30, 60, 360, 15
FAILURES = ("ingest", "quota", "model", "unknown")

_MINUTE = 60_000_000  # microseconds


@dataclass(frozen=True)
class Guard:
    """What a key remembers, and how a row changes it."""

    state: str  # the state's fields, all nullable
    begin: tuple  # the state of a key without a history
    step: Callable[[tuple, int | None, Any], tuple[tuple, tuple | None]]  # (state, microseconds, extra) to (state, results or None)
    lapses: Callable[[tuple], float]  # the microsecond from which the state counts as none
    results: str


def token_bucket(capacity: float, per_minute: float) -> Guard:
    """Tokens come back at a constant rate; a request takes one or is told how long to wait."""
    rate = per_minute / 60.0

    def step(state: tuple, micros: int | None, _) -> tuple:
        tokens, at = state
        now = None if micros is None else micros / 1e6
        passed = 0.0 if now is None or at is None else max(0.0, now - at)
        tokens = float(capacity) if at is None else min(float(capacity), tokens + passed * rate)
        ok = tokens >= 1
        wait = None if ok else max(1, math.ceil((1 - tokens) / rate))
        tokens -= ok
        return (tokens, now), (ok, math.floor(tokens), wait)

    def lapses(state: tuple) -> float:
        tokens, at = state
        return math.ceil(1e6 * (at + (capacity - tokens) / rate)) + 1_000_000  # full again, past any rounding

    return Guard("tokens double, at double", (float(capacity), None), step, lapses, "allowed boolean, remaining int, retry_after int")


def reuse(minutes: int) -> Guard:
    """A request repeats one whose result is younger than the limit; a hit does not extend its age."""

    def step(state: tuple, micros: int | None, _) -> tuple:
        (since,) = state
        hit = since is not None and micros is not None and micros - since < minutes * _MINUTE
        return (since if hit else micros,), (hit,)

    return Guard("since long", (None,), step, lambda state: state[0] + minutes * _MINUTE, "reused boolean")


def ban() -> Guard:
    """A failure (a row with minutes) bans later attempts (rows without) while it lasts; a shorter one does not shorten it."""

    def step(state: tuple, micros: int | None, minutes: float | None) -> tuple:
        (until,) = state
        if minutes is None:
            return state, (until is not None and micros is not None and micros < until,)
        lapses = until if micros is None else micros + int(minutes) * _MINUTE
        return (lapses if until is None or lapses is None else max(until, lapses),), None

    return Guard("until long", (None,), step, lambda state: state[0], "skipped boolean")


def _fold(rows: DataFrame, key: list[str], guard: Guard) -> DataFrame:
    """``key, ts, event_id`` and the guard's results for each row.

    A key's rows come sorted to one task and pass through it; only the state of
    the key at hand is held, so a key may have any number of rows.
    """
    names = [*key, "ts", "event_id"]
    typed = rows.select(*key, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    dealt = typed.repartition(*key).sortWithinPartitions(*names).withColumn("__micros", F.unix_micros("ts"))
    kinds = [field.split()[1] for field in guard.results.split(", ")]
    types = [{"boolean": pa.bool_(), "int": pa.int32()}[kind] for kind in kinds]

    def same(a, b) -> bool:
        return a == b or (a != a and b != b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, guard.begin
        for batch in batches:
            out = []
            for *own, micros in zip(*(batch.column(name).to_pylist() for name in [*key, "__micros"])):
                if at is None or not all(map(same, own, at)):
                    at, state = own, guard.begin
                state, result = guard.step(state, micros, None)
                out.append(result)
            columns = zip(*out) if out else [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), *arrays], names=[*names, *(f.split()[0] for f in guard.results.split(", "))])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema)
    return dealt.mapInArrow(run, f"{own}, {guard.results}")


class _InOrder(StatefulProcessor):
    """Runs a guard over a key's rows in the order of their times, each when the watermark has passed it."""

    def __init__(self, key: list[str], guard: Guard):
        self.key, self.guard = key, guard

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, event_id long, extra double")
        self.state = handle.getValueState("state", self.guard.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).dropna(subset=["ts"])
        if len(frame):
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            extra = [None if pd.isna(x) else float(x) for x in frame["extra"]]
            self.waiting.appendList(list(zip(micros.tolist(), frame["event_id"].astype("int64").tolist(), extra)))
            self._wake(micros.min())
        yield from ()

    def _wake(self, micros: float) -> None:
        self.handle.registerTimer(int(micros // 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due = [r for r in rows if r[0] <= passed]
        state = tuple(self.state.get()) if self.state.exists() else self.guard.begin
        out = []
        for micros, event_id, extra in due:
            state, result = self.guard.step(state, micros, extra)
            if result is not None:
                out.append((*key, pd.Timestamp(micros, unit="us"), event_id, *result))
        if due:
            later = rows[len(due) :]
            self.waiting.put(later) if later else self.waiting.clear()
            if later:
                self._wake(later[0][0])
        if state != self.guard.begin:
            lapses = self.guard.lapses(state)
            if lapses <= passed:
                self.state.clear()
            else:
                self.state.update(state)
                self._wake(lapses)
        if out:
            kinds = dict(f.split() for f in self.guard.results.split(", "))
            frame = pd.DataFrame(out, columns=[*self.key, "ts", "event_id", *kinds])
            yield frame.astype({name: "Int32" for name, kind in kinds.items() if kind == "int"})

    def close(self) -> None:
        pass


def _stream(rows: DataFrame, key: list[str], guard: Guard, delay: str, extra: Column | None = None) -> DataFrame:
    own = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    extra = F.lit(None).cast("double") if extra is None else extra.cast("double")
    typed = rows.select(*key, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), extra.alias("extra"))
    schema = f"{own}, ts timestamp, event_id long, {guard.results}"
    return typed.withWatermark("ts", delay).groupBy(*key).transformWithStateInPandas(_InOrder(key, guard), schema, "Append", "EventTime")


def throttle(requests: DataFrame, capacity: float = CAPACITY, per_minute: float = PER_MINUTE) -> DataFrame:
    """W1, batch: ``client, ts, event_id`` to decisions of a token bucket per client."""
    return _fold(requests, ["client"], token_bucket(capacity, per_minute))


def throttle_stream(requests: DataFrame, capacity: float = CAPACITY, per_minute: float = PER_MINUTE, delay: str = "1 minute") -> DataFrame:
    """W1, streaming: rows may be up to ``delay`` out of order; needs the RocksDB state store."""
    return _stream(requests, ["client"], token_bucket(capacity, per_minute), delay)


def dedup_ttl(requests: DataFrame, key: list[str], minutes: int = DEDUP_MINUTES) -> DataFrame:
    """W2, batch."""
    return _fold(requests, key, reuse(minutes))


def dedup_stream(requests: DataFrame, key: list[str], minutes: int = DEDUP_MINUTES, delay: str = "1 minute") -> DataFrame:
    """W2, streaming: rows may be up to ``delay`` out of order; needs the RocksDB state store."""
    return _stream(requests, key, reuse(minutes), delay)


def suppression(events: DataFrame, block_minutes: int = 60) -> DataFrame:
    """``pair, ts, event_id, ttl_minutes`` (null for attempts): an attempt is skipped while a failure before it lasts.

    The running maximum is taken on two levels, so that a pair with a long
    history is many tasks: each block of time has the maximum of its own failures,
    a window over a pair's blocks carries it on, and inside a block the carried
    value is one more row before the others.
    """
    lapses = F.unix_micros("ts") + F.col("ttl_minutes").cast("long") * _MINUTE
    block = F.floor(F.unix_micros("ts") / (block_minutes * _MINUTE))
    rows = events.select("pair", block.alias("block"), F.lit(1).alias("own"), "ts", "event_id", lapses.alias("lapses"), F.col("ttl_minutes").isNull().alias("attempt"))
    tops = rows.groupBy("pair", "block").agg(F.max("lapses").alias("lapses"))
    earlier = Window.partitionBy("pair").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("lapses", F.max("lapses").over(earlier)).where("lapses is not null and block is not null")
    none = {name: F.lit(None).cast(kind) for name, kind in (("ts", rows.schema["ts"].dataType), ("event_id", rows.schema["event_id"].dataType))}
    carried = carried.select("pair", "block", F.lit(0).alias("own"), *(c.alias(name) for name, c in none.items()), "lapses", F.lit(False).alias("attempt"))
    before = Window.partitionBy("pair", "block").orderBy("own", "ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.unionByName(carried).withColumn("until", F.max("lapses").over(before)).where("attempt")
    return marked.select("pair", "ts", "event_id", F.coalesce(F.unix_micros("ts") < F.col("until"), F.lit(False)).alias("skipped"))


def suppression_stream(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """W3, streaming: rows may be up to ``delay`` out of order; needs the RocksDB state store."""
    return _stream(events, ["pair"], ban(), delay, F.col("ttl_minutes"))


def redeem_join(puts: DataFrame, reads: DataFrame, minutes: int = REDEEM_MINUTES, streaming: bool = False) -> DataFrame:
    """A token is redeemed within the limit and for its own report; works on streams, with watermarks.

    Time is cut into slices as long as the limit. A put stands in its own slice
    and the next, a read in its own; they meet on the slice as well, so that a
    token with a long history is dealt out and each read meets the puts of two
    slices only.
    """
    if streaming:
        puts, reads = puts.withWatermark("put_ts", "1 hour"), reads.withWatermark("read_ts", "1 hour")
    slice_of = lambda ts: F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (minutes * _MINUTE))
    p = puts.withColumn("__slice", F.explode(F.array(slice_of("put_ts"), slice_of("put_ts") + 1))).alias("p")
    r = reads.withColumn("__slice", slice_of("read_ts")).alias("r")
    within = F.expr(f"r.read_ts >= p.put_ts AND r.read_ts <= p.put_ts + INTERVAL {minutes} MINUTE")
    same = (F.col("p.token") == F.col("r.token")) & (F.col("p.report_id") == F.col("r.report_id")) & (F.col("p.__slice") == F.col("r.__slice"))
    return p.join(r, same & within).select("p.token", "p.report_id", "p.put_id", "r.read_id", "p.put_ts", "r.read_ts")


def analysis_metrics(log: DataFrame, streaming: bool = False) -> DataFrame:
    """Analyses per hour and document type: completed ones with their scores, and failed ones by reason.

    ``log`` has ``ts, document_type, score`` and ``failure`` (null for completed
    analyses; a reason that is none of the four counts as unknown). Failed
    analyses have no document type.
    """
    rows = log.withWatermark("ts", "1 hour") if streaming else log
    failed = F.col("failure").isNotNull()
    reason = F.when(F.col("failure").isin(*FAILURES), F.col("failure")).otherwise("unknown")
    kind = F.when(~failed, F.col("document_type")).alias("document_type")
    counts = [F.count_if(failed & (reason == r)).alias(f"failed_{r}") for r in FAILURES]
    per = rows.groupBy(F.window("ts", "1 hour").alias("w"), kind).agg(F.count_if(~failed).alias("analyses"), F.sum(F.when(~failed, F.col("score"))).alias("score"), *counts)
    return per.select(F.col("w.start").alias("hour"), "document_type", "analyses", "score", *[f"failed_{r}" for r in FAILURES])


def streaming_scoring(views: DataFrame, path: str, checkpoint: str):
    """Arriving fact views are scored as they come; returns the running query."""

    def write(batch: DataFrame, number: int) -> None:
        score_documents(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return views.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
