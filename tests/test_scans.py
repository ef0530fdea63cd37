"""Running values and the monotone chain of one key, in blocks, against windows and the plain fold."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodelytics.operators import folds, scans
from nodelytics.operators import windows as W


@pytest.fixture(scope="module")
def rows(spark):
    """One busy key with a burst, an outlier far away and ties in time, and a quiet one; nulls in between."""
    rng = random.Random(4)
    made = [("a", -(10**15), 0, 1.0)] + [("a", rng.choice([5, rng.randrange(10**6), 500_000 + rng.randrange(50)]), i, rng.choice([None, float(rng.randrange(50)), i / 100])) for i in range(1, 3000)]
    made += [("b", i, 10_000 + i, float(i % 7)) for i in range(20)]
    return spark.createDataFrame(made, "k string, us long, n long, v double")


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("before", [False, True])
def test_running_equals_windows(rows, by, before):
    values = {"last": ("last", F.col("v")), "high": ("max", F.col("v")), "low": ("min", F.col("v"))}
    got = scans.running(rows, by, "us", ["n"], values, before, rows=70)
    w = Window.partitionBy(*by).orderBy("us", "n").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = rows.withColumns({"last": F.last("v", ignorenulls=True).over(w), "high": F.max("v").over(w), "low": F.min("v").over(w)})
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blocks_are_alike(rows):
    """An outlier does not put the rest into one block, and rows of one time stay together."""
    cut = scans.with_block(rows.filter("k = 'a'"), ["k"], "us", 70)
    sizes = {r["_block"]: r["count"] for r in cut.groupBy("_block").count().collect()}
    assert len(sizes) > 10
    assert cut.groupBy("us").agg(F.count_distinct("_block").alias("n")).filter("n > 1").isEmpty()


def test_monotone_blocks_equal_the_fold(rows):
    df = rows.filter("v is not null").withColumn("m", F.pmod(F.xxhash64("n"), F.lit(40)) + F.col("us") / 50_000)
    for by in (["k"], []):
        got = scans.monotone(df, by, ["us", "n"], ["v", "m"], rows=400)
        want = folds.monotone_filter(df, by, ["us", "n"], ["v", "m"])
        assert got.columns == df.columns and sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect())
    assert scans.monotone(df.limit(0), ["k"], ["us", "n"], ["v"], rows=70).count() == 0


def test_pruned_means_equal_a_plain_fold(spark):
    """Three thousand snapshots with long absences and snapshots of zeros."""
    rng, means, rows, want = random.Random(6), {}, [], {}
    for i in range(3000):
        seen = {k: rng.choice([0.0, 1e-6, 5.0, 300.0]) if i % 37 else 0.0 for k in range(12) if rng.random() < (0.4, 0.02)[k % 2]}
        rows += [("s", i, k, v) for k, v in seen.items()]
        if seen and max(seen.values()) <= 0:
            means = {}
            want.update({(i, k): None for k in seen})
            continue
        if not seen:
            means = {k: m * 0.7 for k, m in means.items()}
        else:
            means = {k: means.get(k, 0.0) * 0.7 + 0.3 * seen.get(k, 0.0) for k in means.keys() | seen.keys()}
        want.update({(i, k): means[k] for k in seen})
        means = {k: m for k, m in means.items() if m >= 1e-9}
    made = W.ewma_pruned(spark.createDataFrame(rows, "scope string, idx long, key int, v double"), ["scope"], "key", "idx", "v", 0.3)
    got = {(r.idx, r.key): r.ewma for r in made.collect()}
    assert got.keys() == want.keys()
    assert all((a is None) == (got[k] is None) and (a is None or abs(a - got[k]) <= 1e-9 + 1e-9 * a) for k, a in want.items())
    assert None in want.values()
