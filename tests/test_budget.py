"""Budgets against a per-key fold written the plain way, hot keys included."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import budget as B
from recordloom.session import fresh_path
from recordloom.streaming.budgets import stream_admit

START = dt.datetime(2026, 1, 1)
SCHEMA = "key string, ts timestamp_ntz, seq long, kind string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def brute(rows, limit, window):
    alive, out = {}, {}
    for key, ts, seq, kind in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        hits = [h for h in alive.get(key, []) if h > ts - dt.timedelta(seconds=window)]
        if len(hits) >= limit:
            left = (hits[len(hits) - limit] + dt.timedelta(seconds=window) - ts).total_seconds()
            out[seq] = (False, max(1, math.ceil(left)))
        else:
            out[seq] = (True, 0)
            if kind in ("spend", "fail"):
                hits.append(ts)
            elif kind == "ok":
                hits = []
        alive[key] = hits
    return out


def run(spark, rows, limit, window, slices=None, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = B.admit(df, "key", "ts", "seq", limit, window, F.col("kind"), slices=slices, **kw).collect()
    assert len(got) == len(rows)
    return {r["seq"]: (r["admitted"], r["retry_after"]) for r in got}


def spends(*seconds):
    return [("k", at(s), i, "spend") for i, s in enumerate(seconds)]


def test_three_hits_then_refused(spark):
    got = run(spark, spends(0, 0, 0, 20), 3, 60)
    assert [got[i] for i in range(4)] == [(True, 0)] * 3 + [(False, 40)]


def test_window_slides_and_boundary_hit_is_expired(spark):
    got = run(spark, spends(0, 30, 30, 60, 61, 90), 3, 60)
    assert [got[i][0] for i in range(6)] == [True, True, True, True, False, True]
    assert run(spark, spends(0, 30, 30, 61, 61), 3, 60)[4] == (False, 29)


def test_limit_zero_or_disabled_admits_all(spark):
    rows = spends(*[0] * 9)
    assert set(run(spark, rows, 0, 60).values()) == {(True, 0)}
    assert set(run(spark, rows, 1, 60, enabled=False).values()) == {(True, 0)}


def test_login_rules(spark):
    kinds = ["fail", "fail", "ok", "fail", "blocked", "fail", "ok", "fail"]
    got = run(spark, [("k", at(i), i, k) for i, k in enumerate(kinds)], 2, 100)
    # The success at 2 gives the budget back; the one at 6 comes while it is used up.
    assert [got[i][0] for i in range(8)] == [True, True, False, False, False, False, False, False]
    kinds = ["fail", "ok", "fail", "blocked", "fail", "ok"]
    got = run(spark, [("k", at(i), i, k) for i, k in enumerate(kinds)], 2, 100)
    assert [got[i][0] for i in range(6)] == [True, True, True, True, True, False]


@pytest.mark.parametrize("seed, limit, window, hot", [(1, 2, 50, .9), (2, 5, 300, .5), (3, 1, 7, 1.0), (4, 3, 1000, .34)])
def test_random_events_with_a_hot_key_over_many_slices(spark, seed, limit, window, hot):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < hot else f"k{rng.randint(0, 20)}", at(rng.randint(0, 3000) / 2), i,
             rng.choice(["spend", "fail", "fail", "ok", "blocked"] if seed % 2 else ["spend"])) for i in range(1500)]
    assert run(spark, rows, limit, window, slices=9) == brute(rows, limit, window)


def test_slices_split_a_hot_key(spark):
    from recordloom.operators.shuffle import SLICE, sliced
    rows = spark.createDataFrame(spends(*range(900)), SCHEMA)
    sizes = [r["count"] for r in sliced(rows, ["key", "ts", "seq"], 6).groupBy(SLICE).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 300


@pytest.mark.parametrize("slices", [1, 7])
def test_sliding_hits(spark, slices):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < .7 else f"k{rng.randint(0, 9)}", at(rng.randint(0, 200)), i, "spend") for i in range(800)]
    got = B.sliding_hits(spark.createDataFrame(rows, SCHEMA), "key", "ts", "seq", 30, slices=slices).collect()
    window = dt.timedelta(seconds=30)
    for r in got:
        want = sum(1 for k, ts, seq, _ in rows if k == r["key"] and (ts, seq) <= (r["ts"], r["seq"]) and ts > r["ts"] - window)
        assert r["hits"] == want
    assert len(got) == len(rows)


def test_idle_keys(spark):
    rows = [("a", at(0), 0, "spend"), ("b", at(1), 1, "spend"), ("a", at(5), 2, "spend")]
    now = F.lit(str(at(61))).cast("timestamp_ntz")
    got = B.idle_keys(spark.createDataFrame(rows, SCHEMA), "key", "ts", 60, now).collect()
    assert [r["key"] for r in got] == ["b"]


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    rng = random.Random(8)
    times = sorted(rng.randint(0, 4000) for _ in range(400))
    rows = [(rng.choice("abc"), at(t), i, rng.choice(["fail", "fail", "ok", "blocked"])) for i, t in enumerate(times)]
    source = str(tmp_path / "in")
    for n in range(4):
        spark.createDataFrame(rows[n * 100:(n + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    out = fresh_path(spark, "out")
    q = (stream_admit(stream, "key", "ts", "seq", 2, 120, "1 hour", F.col("kind")).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", fresh_path(spark, "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["seq"]: (r["admitted"], r["retry_after"]) for r in spark.read.parquet(out).collect()}
    assert got == brute(rows, 2, 120)
