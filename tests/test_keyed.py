"""Chains, recent keys and replies: streams of several batches equal their batch twins and plain models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nodelytics.operators import chains as C
from nodelytics.operators import joins
from nodelytics.streaming import keyed, state

T0 = dt.datetime(2026, 5, 25)
STAGES = ["open", "ask", "work", "answer", "send"]


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def batches(spark, tmp_path):
    """Each list of rows becomes one micro-batch; the query is restarted in between."""

    def run(parts, schema, make):
        src, out = str(tmp_path / "src"), str(tmp_path / "out")
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            made = make(spark.readStream.schema(schema).parquet(src))
            query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        return spark.read.schema(made.schema).parquet(out)

    return run


def chain_rows(rng, n, node):
    """Interleaved chains: most are whole, some lose a row, repeat one, or stop."""
    rows, t = [], 0
    live: list[list] = []
    for i in range(n):
        t += rng.choice([1, 1, 2, 30])
        if rng.random() < 0.25 or not live:
            live.append([f"s{rng.randrange(n // 4)}", f"r{i}", 0])
        c = rng.choice(live)
        stage = STAGES[c[2]]
        rows.append((node, stage, c[0] if stage in ("open", "ask", "send") else None, None if stage == "open" else c[1], f"t{c[1]}" if stage in ("answer", "send") else None, at(t)))
        if rng.random() < 0.9:
            c[2] += 1
        if c[2] == 5 or rng.random() < 0.05:
            live.remove(c)
    return rows


def test_chains_equal_their_batch_twin(spark, batches):
    rng = random.Random(3)
    rows = [(*r, i) for i, r in enumerate(sorted(chain_rows(rng, 240, "a") + chain_rows(rng, 240, "b"), key=lambda r: r[5]))]
    end = ("z", "open", "last", None, None, at(100_000), len(rows))
    schema = "node string, stage string, chain string, alias string, token string, ts timestamp, seq long"
    parts = [rows[:100], rows[100:101], rows[101:300], rows[300:], [end], [(*end[:5], at(200_000), len(rows) + 1)]]
    make = lambda s: keyed.chains(s, "node", "stage", "chain", "alias", "token", "ts", "seq", STAGES, 60, "0 seconds", capacity=6)
    got = batches(parts, schema, make)
    df = spark.createDataFrame([r for p in parts for r in p], schema).withColumn("us", F.unix_micros("ts"))
    want = C.chains(df, ["node"], "stage", "chain", "alias", "token", "us", "seq", STAGES, 60, 6, as_of_us=int(at(200_000).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6))
    pick = lambda d, key: sorted((getattr(r, key), r.chain or "", r.us, -1 if r.seq is None else r.seq, r.verdict, r.duration_s or -1.0) for r in d.collect())
    got, want = [r for r in pick(got, "key") if r[0] != "z"], [r for r in pick(want, "node") if r[0] != "z"]
    assert got == want
    verdicts = {r[4] for r in got}
    assert verdicts == {"opened", "moved", "completed", "unjoinable", "expired"}


def test_chain_rules():
    c = C.Chains(STAGES, 100, 2)
    steps = [("open", "s", None, None), ("ask", "s", "r", None), ("work", None, "r", None), ("answer", None, "r", "t"), ("send", "s", "r", "x"), ("send", "s", "r", "t")]
    assert [c.accept(i, *s)[1] for i, s in enumerate(steps)] == ["opened", "moved", "moved", "moved", "unjoinable", "completed"]
    assert [c.accept(10 + i, *s)[1] for i, s in enumerate(steps[:4] + steps[5:])] == ["opened", "moved", "moved", "moved", "unjoinable"]  # no second completion
    assert c.accept(20, "open", "u", None, None)[1] == "opened" and c.accept(21, "open", "v", None, None)[1] == "unjoinable"  # full
    assert c.accept(22, "ask", "u", "r", None)[1] == "unjoinable"  # the alias is another chain's
    assert sorted(c.expire(500)) == [("s", 13), ("u", 20)] and not c.done and not c.alias
    assert c.accept(501, "what", "s", None, None)[1] == "unknown"
    many = C.Chains(["a", "b", "c"], 10**9, 2)
    for i in range(3):
        for s in "abc":
            assert many.accept(i, s, f"k{i}", None, "t")[1] in ("opened", "moved", "completed")
    assert list(many.done) == [("k1", "t"), ("k2", "t")]  # the oldest went


def test_recent_keys(spark, batches):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([f"m{min(rng.randrange(30), rng.randrange(30))}", None, ""]) if rng.random() < 0.1 else f"m{min(rng.randrange(30), rng.randrange(30))}", i // 3, i) for i in range(600)]
    schema = "key string, member string, us long, seq long"
    got = batches([rows[:200], rows[200:250], rows[250:]], schema, lambda s: keyed.recent(s, "key", "member", "us", "seq", 8))
    want = C.recent(spark.createDataFrame(rows, schema), ["key"], ["us", "seq"], "member", 8)
    pick = lambda d: sorted((r.key, r.seq, r.member or "", r.fresh) for r in d.collect())
    held: dict = {"a": [], "b": []}
    model = []
    for k, m, _, i in rows:
        fresh = not m or m not in held[k]
        if m and fresh:
            held[k] = [*held[k], m][-8:]
        model.append((k, i, m or "", fresh))
    assert pick(got) == pick(want) == sorted(model)
    assert sum(r[3] for r in model) > len({(r[0], r[2]) for r in model})  # some came out again
    assert got.count() == 600  # every copy is there to be counted
    assert C.first_sights(spark.createDataFrame(rows, schema), ["key"], ["us", "seq"], "member", 4096).filter("member <> ''").count() == len({r[:2] for r in rows if r[1]})


def test_outcomes_equal_the_joins(spark, batches):
    """Requests with keys of their own, replies in time, late, repeated, too early or to nobody."""
    rng = random.Random(8)
    rows, seq = [], 0
    for i in range(120):
        t = i * 20
        rows.append((f"v{i % 5}", i // 2, i, "x", False, at(t)))
        for _ in range(rng.choice([0, 1, 1, 2])):
            rows.append((f"v{i % 5}", i // 2, i, rng.choice("xy"), True, at(t + rng.choice([1, 40, 299, 350]))))
        if rng.random() < 0.2:
            rows.append((f"w{i}", 1, 1, "x", True, at(t + 3)))
    rows = [(*r, n) for n, r in enumerate(sorted(rows, key=lambda r: (r[5], r[4])))]
    end = [("z", 0, 0, "x", False, at(t), 9_000 + t) for t in (50_000, 90_000)]
    schema = "validator string, random_id long, round long, source string, reply boolean, ts timestamp, seq long"
    make = lambda s: keyed.outcomes(s, ["validator", "random_id"], ["validator", "random_id", "round"], "source", "reply", "ts", "seq", 300, "0 seconds")
    got = batches([rows[:90], rows[90:91], rows[91:], end[:1], end[1:]], schema, make)
    df = spark.createDataFrame(rows, schema)
    key, loose = ["validator", "random_id", "round"], ["validator", "random_id"]
    sent = df.filter("not reply").select(*key, F.col("ts").alias("sent_ts"))
    acks = df.filter("reply").select(*key, "source", F.col("ts").alias("ack_ts"), "seq")
    want = {r.seq: r.outcome for r in joins.reply_outcomes(sent, acks, key, loose, "source", "sent_ts", "ack_ts", "seq", 300).collect()}
    made = [r for r in got.collect() if r.loose != "z|0"]
    assert {r.seq: r.outcome for r in made if r.seq is not None} == want
    assert set(want.values()) == {"matched", "mismatch", "orphan"}
    gone = joins.unanswered(sent, acks, key, "sent_ts", "ack_ts", 300, F.lit(at(80_000)))
    expired = sorted(r.exact for r in made if r.outcome == "expired")
    assert expired == sorted("|".join(map(str, r)) for r in gone.select(*key).collect()) and expired


def test_state_of_a_key_in_order(spark, batches):
    """Rows of one batch come in any order."""
    rows = [("a", "m1", 30, 3), ("a", "m1", 10, 1), ("a", "m2", 20, 2)]
    got = batches([rows], "key string, member string, us long, seq long", lambda s: keyed.recent(s, "key", "member", "us", "seq", 1))
    assert sorted((r.seq, r.fresh) for r in got.collect()) == [(1, True), (2, True), (3, True)]
    assert state.RUN_ROWS > 0
