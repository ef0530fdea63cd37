"""Trees, unreadable files and generations."""

import os

import pytest
from pyspark.sql import functions as F

from nodelytics.plans import telemetry_jobs
from nodelytics.sources import generations, scan


def test_walk_finds_what_the_file_system_has(spark, tmp_path):
    for i in range(7):
        folder = tmp_path / "home" / f"d{i % 3}" / "deep" / str(i)
        folder.mkdir(parents=True)
        (folder / "f").write_bytes(b"x" * i)
    (tmp_path / "home" / "empty").mkdir()
    os.link(tmp_path / "home" / "d1" / "deep" / "1" / "f", tmp_path / "home" / "again")
    os.symlink(tmp_path / "home", tmp_path / "home" / "loop")
    got = {r.path: r for r in scan.tree(spark, str(tmp_path / "home"), str(tmp_path / "missing"), parts=3).collect()}
    want = {os.path.join(d, n) for d, dirs, files in os.walk(tmp_path / "home") for n in dirs + files}
    assert got.keys() - {str(tmp_path / "missing")} == want
    assert got[str(tmp_path / "missing")].error == "FileNotFoundError"
    first, again = got[str(tmp_path / "home" / "d1" / "deep" / "1" / "f")], got[str(tmp_path / "home" / "again")]
    assert (first.device, first.inode) == (again.device, again.inode) and first.is_regular and first.size == 1
    loop = got[str(tmp_path / "home" / "loop")]
    assert not loop.is_dir and not loop.is_regular
    usage = telemetry_jobs.disk_scopes(scan.tree(spark, str(tmp_path / "home")).withColumn("node_id", F.lit("n")), {"all": str(tmp_path)}).first()
    assert usage.apparent_bytes == sum(range(7)) + 1 and usage.allocated_bytes == sum(os.stat(p).st_blocks * 512 for p in {got[x].inode: x for x in want if got[x].is_regular}.values())


def test_markers_from_a_walk(spark, tmp_path):
    for name in ("2026-05-25T10:00:00Z", "2026-05-24T09:00:00Z", "other"):
        (tmp_path / "runs" / name).mkdir(parents=True)
    made = telemetry_jobs.markers(scan.tree(spark, str(tmp_path / "runs")).withColumn("node_id", F.lit("n")))
    row = made["run_marker"].first()
    assert row.markers == 2 and str(row.newest_start).startswith("2026-05-25 10")


def test_states_of_files(spark, tmp_path):
    (tmp_path / "empty").touch()
    (tmp_path / "short").write_text("abc")
    (tmp_path / "long").write_text("x" * 10)
    (tmp_path / "folder").mkdir()
    os.symlink(tmp_path / "nothing", tmp_path / "broken")
    names = ["empty", "short", "long", "folder", "broken", "absent"]
    paths = spark.createDataFrame([(n, str(tmp_path / n)) for n in names] + [("null", None)], "source string, path string")
    got = {os.path.basename(r.path): (r.state, r.head) for r in scan.file_heads(paths, 4).collect()}
    assert got == {"empty": ("empty", ""), "short": ("readable", "abc"), "long": ("truncated", "xxxx"), "folder": ("unreadable", ""), "broken": ("unreadable", ""), "absent": ("absent", "")}
    states = scan.file_heads(paths, 4).join(paths, "path").select("source", "state")
    values = spark.createDataFrame([(n, 1) for n in names] + [("unseen", 1)], "source string, v int")
    kept = {r.source for r in scan.retained(values, states, ["source"]).collect()}
    assert kept == {"short", "long", "folder", "broken", "unseen"}  # withdrawn only where absence is confirmed
    both = spark.createDataFrame([("s", "absent"), ("s", "unreadable"), ("t", "absent"), ("t", "empty")], "source string, state string")
    assert [r.source for r in scan.confirmed_gone(both, ["source"]).collect()] == ["t"]


def test_generations(spark, tmp_path):
    path = str(tmp_path / "metrics")
    with pytest.raises(FileNotFoundError):
        generations.read_generation(spark, path)
    assert generations.read_generation(spark, path, "a int").count() == 0
    frame = lambda *values: spark.createDataFrame([(v,) for v in values], "a int")
    values = lambda df: sorted(r.a for r in df.collect())
    generations.write_generation(frame(1, 2), path, 0)
    early = generations.read_generation(spark, path)
    generations.write_generation(frame(3), path, 1)
    assert values(early) == [1, 2] and values(generations.read_generation(spark, path)) == [3]  # the early reader keeps its own
    with pytest.raises(Exception, match="broken"):
        generations.write_generation(spark.range(1).select(F.raise_error(F.lit("broken")).cast("int").alias("a")), path, 2)
    assert values(generations.read_generation(spark, path)) == [3]
    generations.write_generation(frame(9), path, 0)  # a late writer does not go back
    assert values(generations.read_generation(spark, path)) == [3]
    generations.write_generation(frame(4), path, 1)  # a repeated batch replaces its own
    assert values(generations.read_generation(spark, path)) == [4]
    assert generations.prune(spark, path, 1) and values(generations.read_generation(spark, path)) == [4]
    assert len([n for n in os.listdir(path) if n.startswith("g")]) == 2  # the current one, and that of the failed later write
    src = str(tmp_path / "src")
    for i in range(3):
        frame(10 + i).coalesce(1).write.mode("append").parquet(src)
    sink = generations.generations_to(str(tmp_path / "s"))
    stream = spark.readStream.schema("a int").option("maxFilesPerTrigger", 1).parquet(src)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(values(generations.read_generation(spark, str(tmp_path / "s")))) == 1
