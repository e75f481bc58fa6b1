"""Sliding budgets over the whole event table, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget as B
from ..operators.embedding import encoder_udf, hashing_encoder
from ..session import fresh_path
from ..streaming.budgets import late_events, stream_admit
from ..streaming.refresh import ServedCorpus, refresh_stream
from .. import fixed_values as fv
from .common import table

SIX_HOURS, LIMIT = 6 * 3600, 2
LOGIN_LIMIT, LOGIN_WINDOW = 2, 48 * 3600


def _login_kind():
    kind = F.col("event_type")
    return F.when(kind.isin("error", "view", "click"), B.FAIL).when(kind == "signup", B.OK).otherwise(B.BLOCKED)


def budget_hits(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return B.sliding_hits(events, "user_id", "ts", "event_id", SIX_HOURS).select("event_id", "user_id", "hits")


def budget_admit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return B.admit(events, "user_id", "ts", "event_id", LIMIT, SIX_HOURS).select("event_id", "user_id", "admitted", "retry_after")


def budget_shared(spark, sf_dir):
    """One budget per event type: a few keys hold all rows."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return B.admit(events, "event_type", "ts", "event_id", 25, SIX_HOURS).select("event_id", "event_type", "admitted", "retry_after")


def login_budget(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return B.admit(events, "user_id", "ts", "event_id", LOGIN_LIMIT, LOGIN_WINDOW, _login_kind()).select(
        "event_id", "user_id", "admitted", "retry_after")


def idle_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now")).scalar()
    return B.idle_keys(events, "user_id", "ts", SIX_HOURS, now).select("user_id")


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_budget(spark, sf_dir):
    """The login budget as a stream over the event file."""
    decided = stream_admit(_event_stream(spark, sf_dir), "user_id", "ts", "event_id", LOGIN_LIMIT, LOGIN_WINDOW,
                           "365 days", _login_kind())
    out = fresh_path(spark, "admitted")
    run = (decided.writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.parquet(out).select(F.col("seq").alias("event_id"), F.col("key").alias("user_id"), "admitted", "retry_after")


def stream_late(spark, sf_dir):
    """The login budget over four deliveries in order of time, some events of the first coming with the last.

    Each delivery is read by a run of the same stream; late events have no decision.
    """
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    us = B.micros(F.col("ts"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    quarter = F.floor((us - F.lit(low)) * 4 / F.lit(high - low + 1))
    arrival = F.when((quarter == 0) & (F.col("event_id") % 97 == 0), 3).otherwise(quarter)
    source, out, checkpoint = (fresh_path(spark, n) for n in ("delivered", "admitted", "stream"))
    for n in range(4):
        events.filter(arrival == n).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        (stream_admit(stream, "user_id", "ts", "event_id", LOGIN_LIMIT, LOGIN_WINDOW, "1 hour", _login_kind()).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    decided = spark.read.parquet(out)
    late = late_events(spark.read.parquet(source), decided, "user_id", "event_id")
    return decided.select(F.col("seq").alias("event_id"), F.col("key").alias("user_id"), "admitted", "retry_after").unionByName(
        late.select("event_id", "user_id", F.lit(None).cast("boolean").alias("admitted"), F.lit(None).cast("long").alias("retry_after")))


def stream_refresh_batches(spark, sf_dir):
    """The changes of `stream_refresh` in three deliveries: every pass but the first writes a delta."""
    events = table(spark, sf_dir, "events")
    highest = events.agg(F.max("event_id")).first()[0]
    corpus, source, checkpoint = ServedCorpus(spark, fresh_path(spark, "corpus")), fresh_path(spark, "delivered"), fresh_path(spark, "stream")
    udf = encoder_udf(hashing_encoder(32))
    for n in range(3):
        events.filter(F.floor(F.col("event_id") * 3 / F.lit(highest + 1)) == n).write.mode("append").parquet(source)
        stream = _changes_of(spark.readStream.schema(events.schema).parquet(source))
        refresh_stream(stream, corpus, udf, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _served(corpus)


def _changes_of(events):
    title = F.concat_ws(" ", F.lit("record"), F.col("user_id").cast("string"), F.col("event_type"))
    status = F.when(F.col("event_type") == "error", "rejected").otherwise("approved")
    return events.select(F.col("user_id").alias("id"), status.alias("status"), F.col("event_id").alias("seq"),
                         title.alias("job_title"), *[F.col("event_type").alias(c) for c in fv.RECORD_COLUMNS if c != "job_title"])


def _served(corpus):
    return corpus.search_table().select("record_id", "job_title", "skills", F.size("full_vec").alias("full_dim"), F.size("title_vec").alias("title_dim"))


def stream_refresh(spark, sf_dir):
    """Parts approved, rejected or changed by their events, served through a stream of changes."""
    changes = _changes_of(_event_stream(spark, sf_dir))
    corpus = ServedCorpus(spark, fresh_path(spark, "corpus"))
    run = (refresh_stream(changes, corpus, encoder_udf(hashing_encoder(32)), fresh_path(spark, "stream"))
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return _served(corpus)


QUERIES = {f.__name__: f for f in (budget_hits, budget_admit, budget_shared, login_budget, idle_keys, stream_budget, stream_late, stream_refresh,
                                   stream_refresh_batches)}

# ------------------------------------------------------------------------------- SQL
_WINDOW = SIX_HOURS * 1_000_000


def _fold(key: str, limit: int, seconds: int, kind: str, events: str = "events") -> str:
    window = seconds * 1_000_000
    return f"""
WITH RECURSIVE ev AS (SELECT event_id, {key} AS key, epoch_us(ts) AS us, {kind} AS kind,
    row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM {events}),
f AS (
  SELECT key, rn, event_id, us, true AS admitted, 0::BIGINT AS retry_after, CASE WHEN kind IN ('spend', 'fail') THEN [us] ELSE [] END AS hits
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT key, rn, event_id, us, len(alive) < {limit},
    CASE WHEN len(alive) < {limit} THEN 0 ELSE greatest(1, ceil((alive[len(alive) - {limit} + 1] + {window} - us) / 1000000.0))::BIGINT END,
    CASE WHEN len(alive) >= {limit} THEN alive WHEN kind IN ('spend', 'fail') THEN list_append(alive, us)
      WHEN kind = 'ok' THEN [] ELSE alive END
  FROM (SELECT e.*, list_filter(f.hits, lambda h: h > e.us - {window}) AS alive FROM f JOIN ev e ON e.key = f.key AND e.rn = f.rn + 1))
SELECT event_id, key AS {key}, admitted, retry_after FROM f"""


_LOGIN = "CASE WHEN event_type IN ('error', 'view', 'click') THEN 'fail' WHEN event_type = 'signup' THEN 'ok' ELSE 'blocked' END"

_SERVED = """
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id)
SELECT user_id AS record_id, 'record ' || user_id || ' ' || t AS job_title, t AS skills, 32 AS full_dim, 32 AS title_dim FROM last WHERE t <> 'error'"""

_LATE = """event_id % 97 = 0 AND (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 4
  // ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events) + 1) = 0"""

ORACLE = {
    "budget_hits": f"""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {_WINDOW - 1} MICROSECONDS PRECEDING AND CURRENT ROW)
  - (count(*) OVER (PARTITION BY user_id, ts) - row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id)) AS hits FROM events""",
    "budget_admit": _fold("user_id", LIMIT, SIX_HOURS, "'spend'"),
    "budget_shared": _fold("event_type", 25, SIX_HOURS, "'spend'"),
    "login_budget": _fold("user_id", LOGIN_LIMIT, LOGIN_WINDOW, _LOGIN),
    "idle_keys": f"""SELECT user_id FROM events GROUP BY user_id
HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL {SIX_HOURS} SECONDS""",
    "stream_budget": _fold("user_id", LOGIN_LIMIT, LOGIN_WINDOW, _LOGIN),
    "stream_late": _fold("user_id", LOGIN_LIMIT, LOGIN_WINDOW, _LOGIN, f"(SELECT * FROM events WHERE NOT ({_LATE}))")
                   + f" UNION ALL SELECT event_id, user_id, NULL, NULL FROM events WHERE {_LATE}",
    "stream_refresh_batches": _SERVED,
    "stream_refresh": _SERVED,
}
