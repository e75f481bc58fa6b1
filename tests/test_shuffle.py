import random

from pyspark.sql import functions as F

from recordloom.operators import shuffle as S
from recordloom.sources.records import assign_batches


def test_number_rows_is_gapless(spark):
    values = random.Random(1).sample(range(10000), 700)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    rows = S.number_rows(df, ["v"], slices=6).collect()
    assert {r["v"]: r["row_no"] for r in rows} == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_batches_of_ten(spark):
    df = spark.createDataFrame([(i,) for i in range(43)], "v long").repartition(3)
    counts = {r["batch_id"]: r["count"] for r in assign_batches(df, ["v"], 10, slices=4).groupBy("batch_id").count().collect()}
    assert counts == {1: 10, 2: 10, 3: 10, 4: 10, 5: 3}


def test_running_sum_over_hot_and_single_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "hot", "hot", "hot", "z"]), i, rng.randint(-3, 9)) for i in range(600)]
    got = S.running_sum(spark.createDataFrame(rows, "k string, o long, v long"), "k", ["o"], "v", "s", slices=8).collect()
    want, total = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + v
        want[o] = total[k]
    assert {r["o"]: r["s"] for r in got} == want


def test_top_per_group_keeps_little_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") >= 0).alias("g"), F.col("id").alias("v"))
    top = S.top_per_group(df, ["g"], [F.desc("v")], 3)
    assert [r["v"] for r in top.orderBy("rank").collect()] == [999, 998, 997]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_broadcast_is_bounded(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 50, "s string")
    assert S.measured_bytes(df) > 50_000
    assert S.broadcast_if_small(df, 10_000) is df
    assert S.broadcast_if_small(df) is not df


def test_lookup_join_with_and_without_broadcast(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", None) for i in range(300)], "i long, k string, x string")
    rows = rows.unionByName(spark.createDataFrame([(999, None, None), (998, "absent", None)], "i long, k string, x string"))
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(300)], "k string, v long")
    want = {i: (1 if i % 3 else i) for i in range(300)} | {999: None, 998: None}
    for limit in (S.BROADCAST_BYTES, -1):
        got = S.lookup_join(rows, table, "k", ["i"], salts=4, max_bytes=limit).select("i", "v").collect()
        assert len(got) == 302 and {r["i"]: r["v"] for r in got} == want


def test_heavy_rows_are_dealt_to_more_tasks(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    dealt = S.spread(rows, 20)
    assert dealt.rdd.getNumPartitions() == 50 and dealt.count() == 1000
    assert S.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
