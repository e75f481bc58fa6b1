"""Budgets kept continuously, per key, over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.budget import SECOND, SPEND, BudgetFold, decide_run, micros

STATE = "hits array<long>"


def stream_admit(events: DataFrame, key: str, ts: str, seq: str, limit: int, window_seconds: float,
                 watermark: str, kind: Column | None = None) -> DataFrame:
    """`(key, seq, us, admitted, retry_after)` of a streaming event table.

    The state of a key is its alive charged hits, at most `limit` numbers.  Events of one
    micro-batch are taken in time order.  Events older than the watermark are not decided
    (`late_events` finds them), so the caller has to say how late one may be; the watermark
    also lets a key be forgotten a window after its last hit.  A micro-batch is bounded by the
    source's rate options, and with it what one key can bring at a time.
    """
    rows = (events.withColumn("_event_time", F.col(ts).cast("timestamp"))
            .withWatermark("_event_time", watermark)
            .select(F.col(key).alias("key"), F.col(seq).alias("seq"), "_event_time",
                    micros(F.col(ts)).alias("us"), (F.lit(SPEND) if kind is None else kind).alias("kind")))
    key_type = rows.schema["key"].dataType.simpleString()
    seq_type = rows.schema["seq"].dataType.simpleString()
    window_ms = int(window_seconds * 1000)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rule = BudgetFold(limit, window_seconds, held)
        batch = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable")
        admitted, waits = decide_run(rule, batch["us"].to_numpy(), batch["kind"].to_numpy(object))
        if rule.hits:
            state.update((list(rule.hits),))
            expires = rule.hits[-1] // 1000 + window_ms + 1
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": group[0], "seq": batch["seq"].values, "us": batch["us"].values,
                            "admitted": admitted, "retry_after": waits})

    return rows.groupBy("key").applyInPandasWithState(
        fold, f"key {key_type}, seq {seq_type}, us long, admitted boolean, retry_after long",
        STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_events(events: DataFrame, decided: DataFrame, key: str, seq: str) -> DataFrame:
    """The side table of a stream: the events that it read but came too late to be decided.

    Every event within the watermark has its row among the `decided` ones (key, seq), so what
    has none was late.  Nothing is lost unseen: count them, or decide them anew in batch.
    """
    named = decided.select(F.col("key").alias(key), F.col("seq").alias(seq))
    return events.join(named, [key, seq], "left_anti")


__all__ = ["stream_admit", "late_events", "SECOND"]
