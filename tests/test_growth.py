"""Steps whose cost must grow no faster than their input: equal to plain forms, and by the plan or passes that bound them."""

import itertools
import json
import os
import random

from pyspark.sql import functions as F

from nodelytics.functions import vocab
from nodelytics.operators import joins, scans
from nodelytics.operators import windows as W
from nodelytics.plans import telemetry_jobs
from nodelytics.plans.all_queries import QUERIES
from nodelytics.sources import readers, scan, sinks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rpc_stages_meet_in_two_shuffles(spark):
    """Repeated stages, ties in time and late answers against all combinations; no join."""
    rng = random.Random(5)
    lines, at = [], {i: [] for i in range(1, 6)}
    for _ in range(400):
        i, t, s, q, r = rng.randrange(1, 6), rng.randrange(1500), f"s{rng.randrange(4)}", rng.randrange(4), rng.randrange(2)
        args = {1: [s], 2: [s, {"r": q}], 3: [{"r": q}], 4: [{"r": q}, r], 5: [s, {"r": q}, r]}[i]
        tag = ["Incoming tcp stream", "Received rpc request", "Rpc task inbound", "Rpc task response", "Outbound response"][i - 1]
        lines.append(("n", json.dumps([f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}.000000", [tag, *args]])))
        at[i].append((t, s, q, r))
    want = {}
    for (t5, s, q, r), (t1, s1, *_) in itertools.product(at[5], at[1]):
        if s1 == s and 0 <= t5 - t1 <= vocab.RPC_TTL_S and any(
            t1 <= t2 <= t3 <= t4 <= t5
            for t2 in [x[0] for x in at[2] if x[1:3] == (s, q)] for t3 in [x[0] for x in at[3] if x[2] == q] for t4 in [x[0] for x in at[4] if x[2:] == (q, r)]
        ):
            want[s, r] = min(want.get((s, r), t5 - t1), t5 - t1)
    made = telemetry_jobs.consensus_rpc(spark.createDataFrame(lines, "node_id string, line string"))["rpc_served"]
    plan = plan_of(made)
    assert want and sorted((x.session, x.duration_s) for x in made.collect()) == sorted((s, float(d)) for (s, _), d in want.items())
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_chains_of_a_block(spark):
    """From any row before, the rows told end where a plain fold ends: random, rising, falling and tied rows of one to three columns."""
    rng = random.Random(8)
    for n, width, shape in itertools.product((1, 7, 60), (1, 2, 3), range(4)):
        rows = [tuple(float(x) for x in ([rng.randrange(9), rng.randrange(9), rng.randrange(9)], [i, i + rng.random() * 5, i], [i, -i, i], [i // 9 + rng.randrange(3), rng.randrange(4) + i // 7, rng.randrange(5)])[shape][:width]) for i in range(n)]
        heads = scans.Heads()
        for r in rows:
            heads.add(r)
        told = heads.told()
        for _ in range(60):
            start = tuple(float(rng.randrange(-60, n + 9)) if shape else float(rng.randrange(-1, 10)) for _ in range(width))
            base = start
            for r in rows:
                base = r if all(x > y for x, y in zip(r, base, strict=True)) else base
            ends = [e for i, e in told if all(x > y for x, y in zip(heads.rows[i], start, strict=True))]
            assert (heads.rows[ends[0]] if ends else start) == base
    rising = scans.Heads()
    for i in range(1000):
        rising.add((float(i), float(i)))
    assert len(rising.told()) <= 2


def test_monotone_takes_one_table_however_far_a_row_reaches(spark, monkeypatch):
    """The first row exceeds all others, so its mark runs through every block; odd values follow no row and are followed by none."""
    written, write = [], scans.Scratch.write
    monkeypatch.setattr(scans.Scratch, "write", lambda self, *a, **k: written.append(1) or write(self, *a, **k))
    rng = random.Random(9)
    made = [("a", i, 1e6 if not i else float(rng.randrange(i + 5)), 1e6 if not i else rng.random() * i) for i in range(600)]
    made += [(None, i, float(i + rng.randrange(40)) if i % 11 else None, float(i + rng.randrange(40))) for i in range(1, 600)]
    made += [("c", i, None if not i else 5.0, 5.0) for i in range(300)]
    df = spark.createDataFrame(made, "k string, n long, v double, m double")
    got = scans.monotone(df, ["k"], ["n"], ["v", "m"], rows=60)
    want, base = [], {}
    for k, n, v, m in made:
        if k not in base or (None not in (v, m, *base[k]) and v > base[k][0] and m > base[k][1]):
            base[k] = (v, m)
            want.append((str(k), n))
    assert sorted((str(r.k), r.n) for r in got.collect()) == sorted(want) and len(want) > 20 and sum(written) == 1


def test_small_blocks_are_few(spark, monkeypatch):
    """Blocks below the usual size do not grow in number with the table: Spark samples for each of them at the driver."""
    monkeypatch.setattr(scans, "SMALL_BLOCKS", 7)
    df = spark.range(3000).selectExpr("'a' AS k", "id AS us")
    assert scans.with_block(df, ["k"], "us", 10).agg({"_block": "max"}).first()[0] == 7


def test_windows_in_spans_of_time(spark):
    """Long gaps, ties, nulls and a null key: the same values as without spans, and no window over a key alone."""
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([rng.randrange(400), rng.randrange(20_000)]) * 7, i, rng.choice([None, float(rng.randrange(90)), float(i)])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, s long, n long, v double").withColumn("ts", F.timestamp_seconds("s"))
    c = F.coalesce(F.col("v") % 5 > 0, F.lit(True))
    for made in (
        lambda s: W.increase(df, ["k"], "ts", "v", 600, "n", spread_s=s), lambda s: W.deriv(df, ["k"], "ts", "n", 300, spread_s=s),
        lambda s: W.hold_for(df, ["k"], "ts", "n", c, 120, spread_s=s), lambda s: W.hold_for(df, ["k"], "ts", "n", F.col("n") > 40, 9000, spread_s=s),
    ):
        for span in (700, 10_800):
            got = made(span)
            assert got.columns == made(None).columns
            assert sorted(map(str, got.collect())) == sorted(map(str, made(None).collect()))


def test_latest_partner_without_all_pairs(spark):
    """Ties in time, null times and two keys, as the best of all pairs; no rows are written out a second time for it."""
    rng = random.Random(12)
    made = lambda n, wide: spark.createDataFrame([(rng.choice("ab"), i, rng.choice([None, rng.randrange(wide), rng.randrange(wide)])) for i in range(n)], "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    left, right = made(300, 9000).toDF("k", "a", "a_ts"), made(300, 9000).toDF("k", "b", "b_ts")
    order = [F.greatest("a_ts", "b_ts").desc(), F.abs(W.micros("a_ts") - W.micros("b_ts")), F.col("b")]
    want = joins.band_pair(left, right, ["k"], "a_ts", "b_ts", 30, order, ["a"])
    got = joins.latest_pair(left, right, ["k"], "a_ts", "b_ts", 30, F.col("b"))
    key = lambda df: sorted((r.k, r.a, r.b, r.b_ts) for r in df.select("k", "a", "b", "b_ts").collect())
    assert key(got) == key(want) and 50 < len(key(want)) < 300
    assert "Generate" not in plan_of(got)


def test_band_query_takes_the_latest_partner(spark):
    assert "Generate" not in plan_of(QUERIES["band_pair"](spark, "/root/testdata/sf0.001"))


def test_latest_unanswered_in_one_shuffle(spark):
    """Repeated requests, ties in time, null keys and times, as the join; the number of tasks does not come from packed bytes."""
    rng = random.Random(13)
    made = [(rng.choice([None, *"abcdefgh"]), rng.randrange(9), rng.random() < 0.5, rng.choice([None, *[rng.randrange(300)] * 20])) for _ in range(700)]
    df = spark.createDataFrame(made, "k string, n int, reply boolean, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = joins.latest_unanswered(df, ["k", "n"], "reply", "ts", 20, F.timestamp_seconds(F.lit(280)))
    plan = plan_of(got)
    latest = df.filter("not reply").groupBy("k", "n").agg(F.max("ts").alias("sent_ts"))
    want = joins.unanswered(latest, df.filter("reply"), ["k", "n"], "sent_ts", "ts", 20, F.timestamp_seconds(F.lit(280)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and 10 < want.count() < 80
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1


def test_expired_heartbeats_parse_once(spark):
    plan = plan_of(QUERIES["job_heartbeat_expired"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and plan.count("Scan parquet") == 1 and plan.count("REPARTITION_BY_NUM") == plan.count("Exchange")


def test_a_long_file_is_put_in_order_by_many_tasks(spark, tmp_path, monkeypatch):
    """Names, ties, empty lines and ends of their own; nothing is left beside the files, and no task holds a file's rows."""
    monkeypatch.setattr(sinks, "PIECE_ROWS", 100)
    rng, root = random.Random(14), str(tmp_path / "files")
    rows = [(rng.choice(["a/long", "a/long", "a/long", "b/c/d", f"s/{rng.randrange(20)}"]), rng.choice([None, *range(900)]), rng.choice([None, "", f"é{i}"]), rng.choice(["\n", "\n", ""])) for i in range(3000)]
    rows = [(p, n, t if n is None else f"{n}", e if n is None else "\n") for p, n, t, e in rows if n is not None or p != "a/long"]
    df = spark.createDataFrame(rows, "path string, n int, line string, end string").repartition(3)
    dealt, run = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: (dealt.append(self), run(self, *a, **k))[1])
    assert sinks.write_named_files(df, root, order=["n", "line", "end"], end="end") == len({r[0] for r in rows})
    place = lambda r: (r[1] is not None, r[1], r[2] is not None, r[2] or "", r[3])
    for name in {r[0] for r in rows}:
        want = "".join((t or "") + e for _, _, t, e in sorted((r for r in rows if r[0] == name), key=lambda r: tuple(x if x is not None else 0 for x in place(r))))
        assert (tmp_path / "files" / name).read_text() == want
    assert os.listdir(tmp_path) == ["files"]
    largest = dealt[0].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 400 and sum(r[0] == "a/long" for r in rows) > 1500


def test_many_small_files_leave_little_to_the_driver(spark, tmp_path, monkeypatch):
    """A file that one task has whole is put in place by it; the driver deletes what is left of files at the ends of tasks."""
    left, local = [], sinks.pyarrow.fs.LocalFileSystem

    class Watched(local):
        def delete_dir(self, path):
            left.append(sum(len(files) for _, _, files in os.walk(path)))
            super().delete_dir(path)

    monkeypatch.setattr(sinks.pyarrow.fs, "LocalFileSystem", Watched)
    names = [f"{i % 3}/{i}" for i in range(900)]
    df = spark.createDataFrame([(n, j, f"{n} {j}") for n in names for j in range(2)], "path string, j int, line string")
    assert sinks.write_named_files(df, str(tmp_path / "files"), order=["j"]) == len(names)
    assert left and left[0] <= 2 * spark.sparkContext.defaultParallelism and os.listdir(tmp_path) == ["files"]
    assert all((tmp_path / "files" / n).read_text() == f"{n} 0\n{n} 1\n" for n in names)


def test_no_rows_no_files(spark, tmp_path):
    assert sinks.write_named_files(spark.createDataFrame([], "path string, line string"), str(tmp_path / "none")) == 0 and not os.listdir(tmp_path)


def test_states_of_files_keep_their_row(spark, tmp_path):
    """Columns go with the path, also where a path stands twice; no join."""
    (tmp_path / "a").write_text("abc")
    rows = [("x", str(tmp_path / "a"), 1), ("y", str(tmp_path / "a"), None), (None, str(tmp_path / "b"), 3), ("z", None, 4)]
    got = scan.file_heads(spark.createDataFrame(rows, "k string, at string, n int"), 2, "at", 3, keep=["n", "k"])
    assert {(r.k, r.n, r.state, r["head"]) for r in got.collect()} == {("x", 1, "truncated", "ab"), ("y", None, "truncated", "ab"), (None, 3, "absent", "")}
    assert got.count() == 3 and "Join" not in plan_of(QUERIES["file_states"](spark, "/root/testdata/sf0.001"))


def test_withdrawn_values_meet_their_states_without_a_join_by_path(spark):
    plan = plan_of(QUERIES["withdrawn_when_confirmed"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Join") == 1 and "path" not in plan[plan.index("Join") :].split("\n")[0]  # that of the sources that are gone


def test_lines_stay_where_they_are_read(spark, tmp_path):
    """The lines of a long socket table are not gathered by their file."""
    (tmp_path / "n1").mkdir()
    (tmp_path / "n1" / "tcp").write_text("  sl  local\n" + "".join(f"   {i}: 0100007F:0FA1 00000000:0008 01 0\n" for i in range(500)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = readers.read_socket_table(spark, str(tmp_path / "n1"))
        assert made.filter("not bad and local_port = 4001").count() == 500
        assert "Exchange hashpartitioning" not in plan_of(made)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
