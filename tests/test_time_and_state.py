"""Long series, busy keys, bounded sets and retirement, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from nodelytics.functions import scalars as S
from nodelytics.operators import folds, joins
from nodelytics.operators import windows as W
from nodelytics.plans import jobs
from nodelytics.streaming import state


def test_ewma_over_a_long_series(spark):
    rng = random.Random(1)
    rows = [("a", "x", i, rng.random() * 10) for i in range(3000)] + [("a", "y", i, rng.random()) for i in range(0, 3000, 7)] + [(None, "z", i, 5.0) for i in (0, 255, 256, 257, 511, 700, 2999)]
    made = W.ewma(spark.createDataFrame(rows, "s string, k string, i long, v double"), ["s"], "k", "i", "v", 0.3)
    got = {(r.k, r.i): r.ewma for r in made.collect()}
    assert len(got) == len(rows)
    mean, last = {}, {}
    for _, k, i, v in rows:
        mean[k] = mean.get(k, 0.0) * 0.7 ** (i - last.get(k, i)) + 0.3 * v
        last[k] = i
        assert got[k, i] == pytest.approx(mean[k], rel=1e-9)


def test_pairs_in_time_of_a_busy_key(spark):
    rng = random.Random(2)
    a = [(1, i, rng.randrange(4000)) for i in range(300)] + [(None, 999, 5)]
    b = [(1, i, rng.randrange(4000)) for i in range(300)]
    left = spark.createDataFrame(a, "k long, a long, s long").select("k", "a", F.timestamp_seconds("s").alias("at"))
    right = spark.createDataFrame(b, "k long, b long, s long").select("k", "b", F.timestamp_seconds("s").alias("bt"))
    for low, high in ((0, 7), (-3, 3), (5, 5)):
        got = joins.within(left, right, ["k"], "at", "bt", low, high).collect()
        want = {(x[1], y[1]) for x in a[:300] for y in b if low <= y[2] - x[2] <= high}
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    late = joins.unanswered(left, right, ["k"], "at", "bt", 7, F.timestamp_seconds(F.lit(5000)))
    assert {r.a for r in late.collect()} == {x[1] for x in a if not any(x[0] and 0 <= y[2] - x[2] <= 7 for y in b)}


def test_ttl_members_equal_a_plain_scan():
    rng = random.Random(3)
    members, seen, now = folds.TtlMembers(50, 6), {}, 0
    for _ in range(3000):
        now += rng.choice([0, 0, 1, 9])
        k = rng.choice([*"abcdefghij", None])
        gone = [x for x, t in seen.items() if now - t > 50]
        for x in gone:
            del seen[x]
        added = k not in seen
        seen[k] = now
        dropped = 0
        while len(seen) > 6:
            del seen[min(seen, key=lambda x: (seen[x], x is None, x or ""))]
            dropped += 1
        assert members.touch(k, now) == (added, len(gone), dropped, len(seen)) and members.seen == seen


def test_idle_keys_are_retired(spark, tmp_path):
    rows = [("a", 0), ("b", 0), ("a", 500), ("c", 900), ("b", 2000), ("d", 4000)]
    schema, src = "key string, s long", str(tmp_path / "src")
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("s")))
    state.run_available(state.retire_idle(stream, "key", "ts", 1000, "0 seconds"), "retired", str(tmp_path / "c"))
    got = sorted((r.key, r.last_us // 1_000_000 - 1_700_000_000) for r in spark.table("retired").collect())
    assert got == [("a", 500), ("b", 2000), ("c", 900)] or got == [("a", 500), ("b", 0), ("b", 2000), ("c", 900)]
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("s")))
    kept = W.retire_idle(batch, ["key"], "ts", F.timestamp_seconds(F.lit(1_700_002_600)), 1000)
    assert {r.key for r in kept.collect()} == {"b", "d"}


def test_addresses_of_the_sixth_version(spark):
    texts = ["::1", "FE80::1%eth0", "::ffff:1.2.3.4", "2001:DB8:0:0::1", "1.2.3.4", "x:y", None, "::1"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "a string").select(S.canonical_ip(F.col("a")).alias("c")).collect()]
    assert got == ["::1", None, "1.2.3.4", "2001:db8::1", "1.2.3.4", None, None, "::1"]


def test_columns_are_made_once(spark):
    df = jobs.once(spark.createDataFrame([(1, 2)], "a int, b int"), {"b": F.col("b") + 1, "c": F.col("a")})
    assert df.columns == ["a", "b", "c"] and [tuple(r) for r in df.collect()] == [(1, 3, 1)]
    plan = df.filter("c > 0 and b > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
