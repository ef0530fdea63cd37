"""Health of sources with memory: a batch of what was seen is merged into the state of the generation before.

A state has one row a source.  ``enabled``, ``present``, ``read_ok`` and ``schema_ok`` are 1, 0 or -1 (not known); ``observed`` tells
whether a valid record ever came; ``last_attempt``, ``last_valid`` and ``last_publication`` only move forward; ``errors`` counts
rejects by stage over all generations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FLAGS = ("present", "read_ok", "schema_ok")
_TIMES = ("last_attempt", "last_valid", "last_publication")


def observe(config: DataFrame, files: DataFrame, good: DataFrame, rejects: DataFrame, by: Sequence[str], as_of: Column, ts: str = "ts") -> DataFrame:
    """The state of one generation alone.

    ``config (by, enabled)`` names all sources; ``files (by, state)`` are file states of ``sources.scan``; ``good (by, ts)`` and
    ``rejects (by, ts, stage)`` are records.  Of a source that is disabled nothing is attempted, so its flags are not known.
    """
    keys = list(by)
    listed = files.groupBy(*keys).agg(F.bool_or(F.col("state") != "absent").alias("_there"), F.bool_and(F.col("state") == "absent").alias("_gone"), F.bool_or(F.col("state") == "unreadable").alias("_failed"))
    stages = rejects.groupBy(*keys, "stage").agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("t"))
    wrong = stages.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("errors"), F.max("t").alias("_bad"), F.bool_or(F.col("stage") == "read").alias("_read"))
    right = good.groupBy(*keys).agg(F.max(ts).alias("last_valid"))
    on = F.col("enabled") == 1
    all_ = config.join(listed, keys, "left").join(wrong, keys, "left").join(right, keys, "left")
    newest_good = F.coalesce(F.col("last_valid") >= F.col("_bad"), F.col("last_valid").isNotNull())
    seen = F.col("last_valid").isNotNull() | F.col("_bad").isNotNull()
    failed = F.coalesce(F.col("_failed"), F.lit(False)) | F.coalesce(F.col("_read"), F.lit(False))
    flag = lambda c: F.when(on, c).otherwise(-1)
    return all_.select(
        *keys, "enabled",
        flag(F.when(F.col("_there"), 1).when(F.col("_gone"), 0).otherwise(-1)).alias("present"),
        flag(F.when(failed, 0).when(F.col("_there") | seen, 1).otherwise(-1)).alias("read_ok"),
        flag(F.when(~seen, -1).when(newest_good, 1).otherwise(0)).alias("schema_ok"),
        (on & F.col("last_valid").isNotNull()).alias("observed"),
        F.when(on, as_of).alias("last_attempt"), F.when(on, F.col("last_valid")).alias("last_valid"), F.when(on & F.col("last_valid").isNotNull(), as_of).alias("last_publication"),
        F.when(on, F.coalesce("errors", F.create_map().cast("map<string,bigint>"))).otherwise(F.create_map().cast("map<string,bigint>")).alias("errors"),
    )


def merge(before: DataFrame, now: DataFrame, by: Sequence[str]) -> DataFrame:
    """The retained state after a generation: what is not known now stays as it was; a source that the configuration drops goes."""
    keys = list(by)
    old = before.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*_FLAGS, *_TIMES, "observed", "errors")])
    add = F.map_zip_with("errors", F.coalesce("_errors", F.create_map().cast("map<string,bigint>")), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    on = F.col("enabled") == 1
    joined = now.join(old, keys, "left")
    return joined.select(
        *keys, "enabled", *[F.when(on & (F.col(c) == -1), F.coalesce(f"_{c}", F.lit(-1))).otherwise(F.col(c)).alias(c) for c in _FLAGS],
        (F.col("observed") | F.coalesce("_observed", F.lit(False))).alias("observed"), *[F.greatest(c, f"_{c}").alias(c) for c in _TIMES], add.alias("errors"),
    )


def metrics(state: DataFrame, labels: Column, ts: Column, node: str = "node_id") -> DataFrame:
    """Rows ``(node_id, labels_key, ts, metric, value)`` for the alert rules."""
    pairs = F.array(*[F.struct(F.lit(f"source_{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in ("enabled", "present", "read_ok", "schema_ok")])
    return state.select(node, labels.alias("labels_key"), ts.alias("ts"), F.inline(pairs))
