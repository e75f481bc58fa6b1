"""Sliding-window budgets per key over event logs.

A hit is alive at `now` while it lies in `(now - window, now]`; one exactly `window` old
has expired.  Event tables are `(key, ts, seq)` with `seq` breaking ties of `ts` in order
of arrival; `ts` is taken in microseconds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shuffle import SLICE, running_sum, sliced

SECOND = 1_000_000
SPEND, FAIL, OK, BLOCKED = "spend", "fail", "ok", "blocked"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp column (session zone for zoneless ones)."""
    return F.unix_micros(ts.cast("timestamp"))


def sliding_hits(events: DataFrame, key: str, ts: str, seq: str, window_seconds: float,
                 name: str = "hits", slices: int | None = None) -> DataFrame:
    """Per event the number of alive hits of its key, itself included; every event charges.

    Each hit adds one at its time and takes it back at its expiry, so the count is a
    running sum, which spreads a hot key over as many tasks as its rows fill.
    """
    window = int(window_seconds * SECOND)
    base = events.withColumn("_us", micros(F.col(ts)))
    # At equal times expiries come first, and arrivals follow in order.
    arrive = base.select("*", F.lit(1).alias("_step"), F.lit(1).alias("_kind"))
    expire = base.select(*[(F.col("_us") + window).alias("_us") if c == "_us" else F.col(c) for c in base.columns],
                         F.lit(-1).alias("_step"), F.lit(0).alias("_kind"))
    keep = [key, "_us", "_kind", seq]
    other = [c for c in events.columns if c not in keep]
    timeline = arrive.unionByName(expire).select(*keep, "_step", *other)
    counted = running_sum(timeline, key, ["_us", "_kind", seq], "_step", name, slices)
    return counted.filter(F.col("_kind") == 1).select(*events.columns, name)


def idle_keys(events: DataFrame, key: str, ts: str, window_seconds: float, now: Column) -> DataFrame:
    """E5: keys whose last hit lies a whole window or more before `now`."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_hit"))
    cutoff = micros(now) - int(window_seconds * SECOND)
    return last.filter(micros(F.col("last_hit")) <= cutoff)


class BudgetFold:
    """The ordered decision rule for one key; its whole state is the alive charged hits."""

    def __init__(self, limit: int, window_seconds: float, hits: list[int] | None = None):
        self.limit, self.window = limit, int(window_seconds * SECOND)
        self.hits: deque[int] = deque(hits or [])

    def step(self, now: int, kind: str) -> tuple[bool, int]:
        """(admitted, seconds to wait) of one event; refused events leave no trace."""
        hits = self.hits
        while hits and hits[0] <= now - self.window:
            hits.popleft()
        if self.limit > 0 and len(hits) >= self.limit:
            wait = hits[len(hits) - self.limit] + self.window - now
            return False, max(1, -(-wait // SECOND))
        if self.limit > 0:
            if kind == SPEND or kind == FAIL:
                hits.append(now)
            elif kind == OK:
                hits.clear()
        return True, 0


def charge_run(rule: BudgetFold, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`step` for a run of charging events in order, without a look at each: (admitted, seconds to wait).

    While there is budget, as many events are admitted as it allows; when there is none, all
    until the oldest hit expires are refused and wait for that.
    """
    admitted, waits = np.zeros(len(times), bool), np.zeros(len(times), np.int64)
    hits, at = rule.hits, 0
    while at < len(times):
        while hits and hits[0] <= times[at] - rule.window:
            hits.popleft()
        free = rule.limit - len(hits)
        if free > 0:
            upto = min(at + free, len(times))
            admitted[at:upto] = True
            hits.extend(times[at:upto].tolist())
        else:
            opens = hits[len(hits) - rule.limit] + rule.window
            upto = at + max(1, int(np.searchsorted(times[at:], hits[0] + rule.window)))
            waits[at:upto] = np.maximum(1, -(-(opens - times[at:upto]) // SECOND))
        at = upto
    while hits and len(times) and hits[0] <= times[-1] - rule.window:
        hits.popleft()
    return admitted, waits


def decide_run(rule: BudgetFold, times: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`step` for the events of one key in order; stretches that only charge are taken whole."""
    admitted, waits = np.zeros(len(times), bool), np.zeros(len(times), np.int64)
    if rule.limit <= 0:
        return ~admitted, waits
    other = np.flatnonzero((kinds != SPEND) & (kinds != FAIL))
    begin = 0
    for stop in [*other.tolist(), len(times)]:
        if stop > begin:
            admitted[begin:stop], waits[begin:stop] = charge_run(rule, times[begin:stop])
        if stop < len(times):
            admitted[stop], waits[stop] = rule.step(int(times[stop]), kinds[stop])
        begin = stop + 1
    return admitted, waits


def _by_key(batch: pa.RecordBatch) -> Iterator[tuple[object, slice, np.ndarray, np.ndarray]]:
    """(key, rows, times, kinds) of each stretch of equal keys."""
    codes = batch.column("_key").dictionary_encode().indices.fill_null(-1).to_numpy()
    times = batch.column("_us").to_numpy()
    kinds = np.array(batch.column("_kind").to_pylist(), object)
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for a, b in zip(edges, edges[1:]):
        yield batch.column("_key")[a].as_py(), slice(a, b), times[a:b], kinds[a:b]


def _fold_slices(limit: int, window: float, carried: dict[int, list[int]]):
    """Fold sorted slices; the first key of a slice starts from its carried-in hits."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rule = None, None
        for batch in batches:
            admitted, waits = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            for k, rows, times, kinds in _by_key(batch) if batch.num_rows else ():
                if rule is None:
                    rule, key = BudgetFold(limit, window, carried.get(batch.column(SLICE)[0].as_py())), k
                elif k != key:
                    rule, key = BudgetFold(limit, window), k
                admitted[rows], waits[rows] = decide_run(rule, times, kinds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(admitted, pa.bool_()), pa.array(waits, pa.int64())],
                names=[*batch.schema.names, "admitted", "retry_after"])
    return fold


def _exit_states(limit: int, window: float, carried: dict[int, list[int]]):
    """Fold sorted slices and report only the hits alive for each slice's last key."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rule, number = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            number = batch.column(SLICE)[0].as_py()
            for k, _, times, kinds in _by_key(batch):
                if rule is None:
                    rule, key = BudgetFold(limit, window, carried.get(number)), k
                elif k != key:
                    rule, key = BudgetFold(limit, window), k
                decide_run(rule, times, kinds)
        if rule is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([list(rule.hits)], pa.list_(pa.int64()))],
                names=[SLICE, "hits"])
    return fold


def _carried_hits(cut: DataFrame, limit: int, window: float) -> dict[int, list[int]]:
    """The hits carried into each slice whose first key continues from the slice before.

    Whether an event is admitted depends on all earlier ones of its key, so a key that
    spans slices is solved by rounds: every slice first runs as if nothing came in, then
    slices whose incoming hits turn out different run again, until none does.  After
    round n the first n slices of every key are final, so the result is exact; mostly one
    or two rounds do.  Only slice edges and at most `limit` hits per slice come here.
    """
    edges = [r for r in cut.groupBy(SLICE).agg(F.min("_key").alias("first"), F.max("_key").alias("last"))
             .orderBy(SLICE).collect()]
    follows = {a[SLICE]: b for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}
    carried: dict[int, list[int]] = {}
    active = set(follows)
    while active:
        tails = cut.filter(F.col(SLICE).isin(sorted(active)))
        known = {n: hits for n, hits in carried.items() if n in active}
        exits = {r[SLICE]: list(r["hits"]) for r in
                 tails.mapInArrow(_exit_states(limit, window, known), f"{SLICE} int, hits array<long>").collect()}
        active = set()
        for number, hits in exits.items():
            after = follows[number]
            if carried.get(after[SLICE], []) != hits:
                carried[after[SLICE]] = hits
                # Only a slice filled by the one key passes the change on.
                if after["first"] == after["last"] and after[SLICE] in follows:
                    active.add(after[SLICE])
    return carried


def admit(events: DataFrame, key: str, ts: str, seq: str, limit: int, window_seconds: float,
          kind: Column | None = None, enabled: bool = True, slices: int | None = None) -> DataFrame:
    """Each event with `admitted` and `retry_after` (seconds, 0 when admitted).

    An event is refused while `limit` charged hits of its key are alive, and a refused
    event neither charges nor resets.  Of the admitted ones, `spend` (the default) and
    `fail` charge, `ok` gives the whole budget back and `blocked` does neither.  A limit
    of zero or less, or `enabled=False`, admits everything.
    """
    if limit <= 0 or not enabled:
        return events.withColumns({"admitted": F.lit(True), "retry_after": F.lit(0).cast("long")})
    rows = events.select("*", F.col(key).alias("_key"), micros(F.col(ts)).alias("_us"),
                         (F.lit(SPEND) if kind is None else kind).alias("_kind"))
    cut = sliced(rows, ["_key", "_us", seq], slices)
    carried = _carried_hits(cut, limit, window_seconds)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    decided = cut.mapInArrow(_fold_slices(limit, window_seconds, carried),
                             f"{names}, admitted boolean, retry_after long")
    return decided.drop("_key", "_us", "_kind", SLICE)
