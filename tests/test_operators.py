import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from nodelytics.functions import json
from nodelytics.functions import scalars as S
from nodelytics.operators import aggregates as A
from nodelytics.operators import folds, joins, topk, validation
from nodelytics.operators import windows as W
from nodelytics.plans.rules import node_alerts

ADDRESS = "0x" + "ab12" * 10
T0 = dt.datetime(2026, 5, 25, 10)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_numbers(spark):
    r = one(spark, a=S.hex_to_decimal(F.lit("0x5f5e100")), b=S.hex_to_decimal(F.lit("zz")), c=S.quantity(F.lit("12")), d=S.hex_to_decimal(F.lit("0x" + "f" * 40)), e=S.wei_to_gwei(F.lit("1500000001").cast("decimal(38,0)")), f=S.gas_ratio(F.lit(5), F.lit(0)), g=S.gas_ratio(F.lit(5), F.lit(10)), h=S.byte_size(F.lit("1.5 GB")), i=S.finite_nonneg(F.lit(float("nan"))), j=S.finite_nonneg(F.lit(0.0)), k=S.relation(F.lit(1), F.lit(2)))
    assert (int(r.a), r.b, int(r.c), r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k) == (100_000_000, None, 12, None, 1.500000001, None, 0.5, 1.5 * 1024**3, False, True, "fewer")


def test_addresses_and_hosts(spark):
    r = one(spark, a=S.wire_key(F.lit(ADDRESS.upper().replace("0X", "0x"))), b=S.normalize_address(F.lit("0xabcd..12")), c=S.canonical_ip(F.lit("::ffff:192.0.2.7")), d=S.canonical_ip(F.lit("2001:DB8::0001")), e=S.canonical_ip(F.lit("fe80::1%eth0")), f=S.canonical_ip(F.lit("300.1.1.1")), g=S.dotted(F.array(F.lit(192), F.lit(0), F.lit(2), F.lit(1))), h=S.port_label(F.lit(5), [5, 6]), i=S.port_label(F.lit(7), [5, 6]))
    assert tuple(r) == ("0xab12..ab12", None, "192.0.2.7", "2001:db8::1", None, None, "192.0.2.1", "5", "other")


def test_text_and_times(spark):
    classes = [("first", ["Alpha"]), ("second", ["beta"])]
    r = one(spark, a=S.classify_text(F.lit("has BETA and alpha"), classes), b=S.classify_text(F.lit(" "), classes), c=S.classify_text(F.lit("x"), classes), d=S.name_or_unknown(F.lit(" ")), e=S.parse_ts(F.lit("2026-05-25T10:37:08.672768629")), f=S.parse_ts(F.lit("yesterday")), g=S.path_date(F.lit("20260230")), h=S.direction_port(F.lit("in_4001"))["port"], i=S.basename(F.lit("a/b/c.rs")), j=S.cut_at(F.lit("job home_validator=1"), " home_validator="))
    assert (r.a, r.b, r.c, r.d, r.f, r.g, r.h, r.i, r.j) == ("first", "none", "unknown", "unknown", None, None, 4001, "c.rs", "job")
    assert r.e == dt.datetime(2026, 5, 25, 10, 37, 8, 672768)


def test_strict_json(spark):
    v = json.record(F.lit('{"a": "5", "b": 5, "c": null, "d": 1.5, "e": ["x", ""], "f": {"K": {"z": 1}}}'))
    r = one(spark, a=json.req(v, "$.a", "int"), b=json.req(v, "$.b", "int"), c=json.presence(v, "$.c"), d=json.req(v, "$.d", "int"), e=json.text_array(v, "$.e"), f=json.single_variant(F.try_variant_get(v, "$.f", "variant"))["tag"], g=json.presence(v, "$.zz"), h=json.envelope(json.record(F.lit('["t", 1, 2]'))), i=json.envelope(json.record(F.lit('["t", [1]]')))["ts"], j=json.record(F.lit('{"a":1,"a":2}')))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == (None, 5, "null", None, None, "K", "missing", None, "t", None)


def test_validation(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.4), (3, 1.0), (3, 0.4), (4, -1.0)], "g int, v double")
    assert {r.g: (r.state, r.measured) for r in validation.classify_snapshot(df, ["g"], "v").collect()} == {1: ("initializing", 2), 2: ("no_data", 0), 3: ("measured", 1), 4: ("invalid", 0)}
    good, bad = validation.split_rejects(validation.validate(df, [("x", "neg", F.col("v") < 0), ("x", "later", F.col("v") < 1)]))
    assert good.count() == 1 and {(r.stage, r.reason, r.n) for r in validation.reject_counts(bad).collect()} == {("x", "neg", 1), ("x", "later", 4)}


def test_wide_quantities(spark):
    """Against Python's integers, up to 256 bits."""
    rng = random.Random(1)
    numbers = [0, 1, 15, 10**26 - 1, 10**26, (1 << 60) - 1, 1 << 60, (1 << 124) - 1, 1 << 124, 1 << 200, (1 << 256) - 1] + [rng.getrandbits(rng.randint(1, 256)) for _ in range(60)]
    rows = [(hex(a), str(b), str(a), str(b)) for a in numbers for b in rng.sample(numbers, 5)]
    df = spark.createDataFrame(rows, "a string, b string, x string, y string").withColumns({"wa": S.wide(F.col("a")), "wb": S.wide(F.col("b"))})
    made = df.select("x", "y", S.wide_text(F.col("wa")).alias("a"), S.wide_text(F.col("wb")).alias("b"), S.wide_text(S.wide_sub(F.col("wa"), F.col("wb"))).alias("sub"), S.wide_text(F.least("wa", "wb")).alias("least"), S.wide_ratio(F.col("wa"), F.col("wb")).alias("ratio"), S.wide_gwei(F.col("wa")).alias("gwei"))
    for r in made.collect():
        x, y = int(r.x), int(r.y)
        assert (r.a, r.b, r.sub, r["least"]) == (r.x, r.y, str(max(x - y, 0)), str(min(x, y)))
        assert r.ratio is None if y == 0 else abs(r.ratio - x / y) <= 1e-15 * (x / y)
        assert r.gwei == float(f"{x // 10**9}.{x % 10**9:09d}")
    bad = one(spark, a=S.wide(F.lit(hex(1 << 256))), b=S.wide(F.lit(str(1 << 256))), c=S.wide(F.lit("0xzz")), d=S.wide(F.lit("-1")), e=S.wide_of(F.lit(str(5 * 10**30)).cast("decimal(38,0)")))
    assert (bad.a, bad.b, bad.c, bad.d) == (None, None, None, None) and int(bad.e.mid) == 50_000


def test_wide_priority_fee(spark):
    big = 1 << 200
    txs = spark.createDataFrame([(1, str(big)), (1, "7"), (2, None)], "k int, t string").select("k", S.wide(F.col("t")).alias("fee"))
    rec = spark.createDataFrame([(1, hex(big + 12), "5"), (2, None, "5")], "k int, e string, b string").select("k", S.wide(F.col("e")).alias("effective"), S.wide(F.col("b")).alias("base"))
    made = A.max_priority_fee(txs, rec, "k", S.wide_sub, S.wide_zero()).select("k", S.wide_text(F.col("max_fee")).alias("fee"), "has_fee")
    assert {tuple(r) for r in made.collect()} == {(1, str(big + 7), True), (2, "0", False)}
    r = one(spark, a=S.wide_text(A.priority_fee(F.lit("Eip1559"), S.wide(F.lit(str(big))), S.wide(F.lit(str(big + 3))), S.wide(F.lit(None).cast("string")), S.wide(F.lit("4")), S.wide_sub)))
    assert r.a == str(big - 1)


def test_aggregates(spark):
    inv = spark.createDataFrame([("/a/x", True, 10, 1, 1, 8), ("/a/b/y", True, 10, 1, 1, 8), ("/a/b/z", True, 5, 1, 2, 4), ("/a", False, 0, 1, 3, 0)], "path string, is_regular boolean, size long, device long, inode long, alloc_bytes long")
    got = {r.scope: (r.apparent_bytes, r.allocated_bytes) for r in A.disk_usage(inv, [], {"all": "/a", "b": "/a/b"}).collect()}
    assert got == {"all": (25, 12), "b": (15, 12)}
    fleet = inv.withColumn("node_id", F.explode(F.array(F.lit("n1"), F.lit("n2"))))
    assert {(r.node_id, r.scope, r.apparent_bytes, r.allocated_bytes) for r in A.disk_usage(fleet, ["node_id"], {"all": "/a"}).collect()} == {("n1", "all", 25, 12), ("n2", "all", 25, 12)}
    socks = spark.createDataFrame([(10, 20, "LISTEN"), (20, 10, "LISTEN"), (1, 2, "LISTEN")], "local_port int, remote_port int, state string")
    census = {(r.port, r.side): r.n for r in A.socket_census(socks, [], [10, 20], ["LISTEN"]).collect()}
    assert census == {(10, "local"): 1, (20, "local"): 1, (10, "remote"): 0, (20, "remote"): 0}
    txs = spark.createDataFrame([(1, 5), (1, 9), (2, None)], "k int, fee int").withColumn("fee", F.col("fee").cast("decimal(38,0)"))
    rec = spark.createDataFrame([(1, 7, 1), (1, 4, 1), (2, None, 0)], "k int, effective int, base int").select("k", F.col("effective").cast("decimal(38,0)").alias("effective"), F.col("base").cast("decimal(38,0)").alias("base"))
    assert {(r.k, int(r.max_fee), r.has_fee) for r in A.max_priority_fee(txs, rec, "k").collect()} == {(1, 6, True), (2, 0, False)}
    rates = spark.createDataFrame([(1, i, ["a"] if i % 2 else []) for i in range(200)], "s int, o int, signers array<string>")
    assert [(r.signer, r.rate) for r in A.participation_rate(rates, ["s"], ["o"], "signers").collect()] == [("a", 50.0)]


def test_folds(spark):
    rows = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(1, 1), (5, 0), (2, 2), (4, 1), (3, 3)])], "k int, i int, a int, b int")
    assert [r.i for r in folds.monotone_filter(rows, ["k"], ["i"], ["a", "b"]).orderBy("i").collect()] == [0, 2, 4]
    snaps = spark.createDataFrame([(1, 0, "a", 10.0), (1, 0, "b", 9.0), (1, 1, "a", 0.0), (1, 1, "b", 9.0), (1, 2, "b", 9.0), (1, 3, "b", 0.0)], "n int, s int, k string, v double")
    got = folds.ewma_dominant(snaps, ["n"], "s", "k", "v").orderBy("s").collect()
    assert [r.dominant for r in got] == ["a", "b", "b", None] and got[2].tenure == 2 and got[1].switches == 1
    sets = spark.createDataFrame([(1, i, k, u) for i, (k, u) in enumerate([("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 20)])], "n int, i int, k string, u int").withColumn("us", F.col("u").cast("long") * 1_000_000)
    got = folds.ttl_set(sets, ["n"], ["i"], "k", "us", 10, 2).orderBy("i").collect()
    assert [(r.added, r.expired, r.dropped, r.size) for r in got] == [(True, 0, 0, 1), (True, 0, 0, 2), (False, 0, 0, 2), (True, 0, 1, 2), (True, 2, 0, 1)]


def test_joins(spark):
    reg = spark.createDataFrame([("0xaaaa" + "0" * 32 + "1111",), ("0xaaaa" + "1" * 32 + "1111",), ("0xbbbb" + "0" * 32 + "2222",)], "validator string")
    rows = spark.createDataFrame([("0xaaaa..1111",), ("0xbbbb..2222",)], "t string")
    got = {r.t: r.full for r in joins.expand_truncated(rows, "t", reg, "validator", S.truncate_address(F.col("validator"))).collect()}
    assert got["0xaaaa..1111"] is None and got["0xbbbb..2222"].endswith("2222")
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    assert joins.coalesce_sources(a, spark.createDataFrame([(1, "y"), (2, "z")], "id int, s string"), ["id"]).count() == 2


def test_window_rules(spark):
    minute = lambda i: T0 + dt.timedelta(minutes=i)
    rows = [("up", "a", minute(i), 1.0, "x") for i in range(20)]
    rows += [("block_height", "a", minute(i), 100.0, "x") for i in range(20)]
    rows += [("block_height", "b", minute(i), 100.0, "x") for i in range(20)]
    rows += [("receipt_mismatches_total", "a", minute(i), float(i > 10), "x") for i in range(20)]
    rows += [("parse_errors_total", "a", minute(i), 3.0, "x") for i in range(20)]
    rows += [(m, "a", minute(i), v, "s1") for i in range(20) for m, v in (("source_enabled", 1.0), ("source_read_ok", 0.0), ("source_schema_ok", 1.0))]
    df = spark.createDataFrame(rows, "metric string, node_id string, ts timestamp, value double, labels_key string")
    fired = {(r.node_id, r.rule) for r in node_alerts(df).select("node_id", "rule").distinct().collect()}
    assert fired == {("a", "height_stalled"), ("a", "count_mismatch"), ("a", "source_failed")}


def test_counter_resets(spark):
    rows = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=i), v) for i, v in enumerate([1.0, 3.0, 2.0, 2.5])], "k int, ts timestamp, v double")
    assert [r.increase for r in W.increase(rows, ["k"], "ts", "v", 2).orderBy("ts").collect()] == [0.0, 2.0, 4.0, 4.5]


def test_topk(spark):
    df = spark.createDataFrame([("g", f"k{i}", float(i)) for i in range(5)] + [("z", "a", 0.0)], "g string, k string, v double")
    got = {(r.g, r.label): r.v for r in topk.topn_plus_other(df, ["g"], "k", "v", 2).collect()}
    assert got == {("g", "k4"): 4.0, ("g", "k3"): 3.0, ("g", "other"): 3.0}
    assert isinstance(topk.first_k(df, ["g"], "k", 1).toPandas(), pd.DataFrame)
