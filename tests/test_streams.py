"""Streams whose keys have more rows in a batch than are held at once."""

import glob
import random
import tempfile

import pandas as pd

from nodelytics.operators import folds
from nodelytics.operators import windows as W
from nodelytics.streaming import keyed, state


def test_order_by_runs(monkeypatch):
    monkeypatch.setattr(state, "RUN_ROWS", 20)
    monkeypatch.setattr(state, "PART_ROWS", 7)
    monkeypatch.setattr(state, "FAN", 3)
    values = [random.Random(1).randrange(50) if i % 40 else None for i in range(997)]
    rows = pd.DataFrame({"us": values, "seq": range(997)}).astype({"us": "float64"})
    made = list(state.in_order(iter([rows[i : i + 9] for i in range(0, 997, 9)]), ["us", "seq"]))
    assert max(map(len, made)) <= 7
    assert pd.concat(made, ignore_index=True).equals(rows.sort_values(["us", "seq"], ignore_index=True))
    assert not glob.glob(f"{tempfile.gettempdir()}/runs-*/*")


class _State:
    """A map state in memory."""

    def __init__(self):
        self.held = {}

    def iterator(self):
        return iter([((k,), v) for k, v in self.held.items()])

    def updateValue(self, key, value):
        self.held[key[0]] = value

    def removeKey(self, key):
        del self.held[key[0]]


def test_a_key_comes_out_in_parts(monkeypatch):
    monkeypatch.setattr(state, "RUN_ROWS", 20)
    monkeypatch.setattr(state, "PART_ROWS", 7)
    rows = pd.DataFrame({"key": "a", "member": [str(i % 6) for i in range(300)], "us": range(300, 0, -1), "seq": range(300)})
    for processor, field in ((state.TtlSet(1, 3), "seen"), (state.StickyNames(2), "names")):
        setattr(processor, field, _State())
        made = list(processor.handleInputRows(("a",), iter([rows[:150], rows[150:]]), None))
        assert max(map(len, made)) <= 7 and sum(map(len, made)) == 300


def test_sticky_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, f"m{min(rng.randrange(9), rng.randrange(9))}", rng.randrange(1000) + i // 100 * 1000) for i in range(300)]
    schema = "key string, seq long, member string, us long"
    src, home = str(tmp_path / "src"), str(tmp_path / "home")
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    state.run_available(stream, "", str(tmp_path / "c"), sink=state.sticky_batches("key", "member", "us", "seq", 2, home))
    got = sorted((r.seq, r.key, r.label) for r in spark.read.parquet(f"{home}/rows/*").collect())
    want = W.sticky_topn(spark.createDataFrame(rows, schema), ["key"], "member", ["us", "seq"], 2)
    assert got == sorted((r.seq, r.key, r.label) for r in want.collect())
    timed = state.ttl_batches("key", "member", "us", "seq", 0.00004, 3, home)
    state.run_available(stream, "", str(tmp_path / "d"), sink=timed)
    pick = lambda df: sorted((r.key, r.us, r.added, r.expired, r.dropped, r["size"]) for r in df.collect())
    want = folds.ttl_set(spark.createDataFrame(rows, schema), ["key"], ["us", "seq"], "member", "us", 0.00004, 3)
    assert pick(spark.read.parquet(f"{home}/made/*/state=false")) == pick(want) and want.filter("expired > 0").count() and want.filter("dropped > 0").count()


class _Handle:
    """Counts what a processor asks of the state store; values alone."""

    def __init__(self):
        self.calls, self.timers, self.value = [], [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, ms):
        self.calls.append("register")
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.calls.append("delete")
        self.timers.remove(ms)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_key_of_replies_costs_few_calls(monkeypatch):
    """Four calls of the state store at most, however many requests a key has; nothing is left of a key without requests."""
    rows = pd.DataFrame({"us": [i * 1000 for i in range(200)], "reply": [i % 3 == 1 for i in range(200)], "seq": range(200), "exact": [f"k{i - i % 3}" for i in range(200)], "source": "s"})
    made = []
    for run_rows in (20, 1000):
        monkeypatch.setattr(state, "RUN_ROWS", run_rows)
        processor, handle = keyed.RepliesOfKey(1), _Handle()
        processor.init(handle)
        out = []
        for part in (rows[:120][::-1], rows[120:]):
            handle.calls.clear()
            out += list(processor.handleInputRows(("a",), iter([part[:50], part[50:]]), None))
            assert len(handle.calls) <= 4 and handle.timers
        for now in (1300, 3000):
            handle.calls.clear()
            handle.timers.clear()
            handle.now = now
            out += list(processor.handleExpiredTimer(("a",), handle, None))
            assert len(handle.calls) <= 3
        assert handle.value is None and not handle.timers
        made.append(pd.concat(out, ignore_index=True))
    assert made[0].equals(made[1]) and set(made[0]["outcome"]) == {"matched", "expired"} and made[0]["seq"].notna().sum() == 67
