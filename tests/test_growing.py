"""Growing hourly files: appended, torn, rotated, replaced, over restarts; each committed line comes once."""

import io
import os
import random

import pytest

from nodelytics.sources import growing


@pytest.mark.parametrize("cap", [5, 12, 1000])
def test_ranges_share_lines(cap, monkeypatch):
    """However the bytes are cut, each line belongs to one range."""
    monkeypatch.setattr(growing, "READ_BYTES", 4)
    rng = random.Random(cap)
    data = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 3, 11, 30]))) + b"\n" for _ in range(60)) + b"tail"
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line if len(line) <= cap else None))
        at += len(line) + 1
    for _ in range(40):
        cuts = sorted({0, len(data), *rng.sample(range(len(data)), rng.randint(0, 12))})
        got = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            *lines, last = growing.lines_of(io.BytesIO(data), a, z, cap)
            got += lines
        assert got == want and last[0] == at


class Home:
    def __init__(self, path):
        self.root = str(path / "logs")

    def append(self, node, date, hour, text, mode="a"):
        folder = f"{self.root}/{node}/status/hourly/{date}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{hour}", mode) as f:
            f.write(text)


@pytest.fixture
def follow(spark, tmp_path):
    """Runs the stream over what is there, as a restarted query each time; gives new lines and rejects."""

    def run(home, history, **options):
        out = str(tmp_path / f"out-{history}")
        seen = spark.read.parquet(out).count() if os.path.exists(out) else 0
        growing.read_growing(spark, home.root, "status", history, **options)  # registers the source
        every = spark.readStream.format("growing_lines").options(root=home.root, stream="status", history=history, **options).load()
        query = every.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c-{history}")).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
        made = spark.read.schema(growing.SCHEMA).parquet(out).collect() if os.path.exists(out) else []
        assert len(made) >= seen
        return sorted(((r.node_id, r.file_date, r.file_hour, r.pos, r.line, r.reason) for r in made), key=lambda r: (*r[:4], str(r[4])))

    return run


def test_replay_of_growing_files(follow, tmp_path):
    home = Home(tmp_path)
    home.append("n1", "20260525", 9, "one\ntw")
    home.append("n2", "20260525", 9, "x" * 40 + "\nshort\n")
    options = {"record_cap": "20", "task_bytes": "7"}
    first = follow(home, "replay", **options)
    assert first == [("n1", "20260525", 9, 0, "one", None), ("n2", "20260525", 9, 0, None, "record_too_long"), ("n2", "20260525", 9, 41, "short", None)]
    home.append("n1", "20260525", 9, "o\nthree\nfo")  # the torn line is terminated, another is torn
    home.append("n1", "20260525", 10, "ten\n")
    home.append("n3", "20260525", 7, "late node\n")
    second = follow(home, "replay", **options)
    assert set(second) - set(first) == {("n1", "20260525", 9, 4, "two", None), ("n1", "20260525", 9, 8, "three", None), ("n1", "20260525", 10, 0, "ten", None), ("n3", "20260525", 7, 0, "late node", None)}
    assert follow(home, "replay", **options) == second  # nothing new, nothing again
    # two hours pass while the query is down: one file is drained, one came and aged, the tail of the first stays torn
    home.append("n1", "20260525", 10, "ten more\n")
    for date, hour in (("20260525", 11), ("20260525", 23), ("20260526", 0), ("20260526", 1)):
        home.append("n1", date, hour, f"at {hour}\n")
    third = follow(home, "replay", **options)
    assert set(third) - set(second) == {("n1", "20260525", 10, 4, "ten more", None), ("n1", "20260525", 9, 14, None, "torn_tail"), *[("n1", d, h, 0, f"at {h}", None) for d, h in (("20260525", 11), ("20260525", 23), ("20260526", 0), ("20260526", 1))]}
    # truncation, and a replacement that is longer than what was read
    home.append("n1", "20260526", 1, "new\n", "w")
    home.append("n2", "20260525", 9, "another file with a first line that is long enough\nto be told from the one before it, and then some\n", "w")
    fourth = follow(home, "replay", record_cap="200", task_bytes="1000")
    assert ("n1", "20260526", 1, 0, "new", None) in fourth and len(fourth) == len(set(fourth))
    assert {r[4] for r in fourth if r[0] == "n2"} >= {"short", "another file with a first line that is long enough"}


def test_history_is_skipped_and_batches_are_equal(spark, follow, tmp_path):
    home = Home(tmp_path)
    home.append("n1", "20260525", 8, "old\n")
    home.append("n1", "20260525", 9, "old too\nto")
    assert follow(home, "skip") == []
    rng, want = random.Random(1), []
    home.append("n1", "20260525", 9, "rn\n")
    want.append("torn")
    for step in range(3):
        for hour in (10 + step, 11 + step):
            lines = [f"{step}-{hour}-{i}-" + "y" * rng.randrange(30) for i in range(rng.randrange(1, 9))]
            home.append("n2", "20260525", hour, "".join(f"{x}\n" for x in lines))
            want += lines
        got = follow(home, "skip", task_bytes="16")
        assert sorted(r[4] for r in got) == sorted(want)
