"""Alert rules as data: a condition over a table of series, how long it must hold, and a severity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins, windows

#: A node has many rows, so the rules see it in spans of time.
SPAN_S = 10_800


@dataclass(frozen=True)
class Rule:
    name: str
    condition: Column
    hold_s: int = 0
    severity: str = "warning"


def evaluate(df: DataFrame, rules: Sequence[Rule], by: Sequence[str] = (), ts: str | None = None) -> DataFrame:
    """A row for each rule and row at which it fires; the rules share one pass unless they must hold."""
    instant = [r for r in rules if not r.hold_s]
    held = [r for r in rules if r.hold_s]
    out = None
    if instant:
        fired = F.array_compact(F.array(*[F.when(r.condition, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in instant]))
        out = df.select("*", F.inline(fired))
    for r in held:
        one = windows.hold_for(df, by, ts, ts, r.condition, r.hold_s, "_fires", SPAN_S).filter("_fires").drop("_fires").withColumns({"rule": F.lit(r.name), "severity": F.lit(r.severity)})
        out = one if out is None else out.unionByName(one)
    return out


def pivoted(metrics: DataFrame, names: Sequence[str], by: Sequence[str], ts: str = "ts") -> DataFrame:
    """A long metric table (metric, value) as a column for each name at each time of a series."""
    return metrics.filter(F.col("metric").isin(list(names))).groupBy(*by, ts).agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def node_alerts(metrics: DataFrame, by: Sequence[str] = ("node_id",), ts: str = "ts") -> DataFrame:
    """The data rules over a node's metrics: height stalled or slow, mismatches, parse errors, failed sources, stale files, absent processes, stale fallback."""
    up = metrics.filter("metric = 'up' and value > 0").select(*by)
    height = windows.deriv(metrics.filter("metric = 'block_height'"), by, ts, "value", 300, spread_s=SPAN_S)
    height = joins.and_on(height, up, by)
    slope = F.col("slope")
    parts = [
        evaluate(height, [Rule("height_stalled", slope < 1, 300, "critical"), Rule("height_slow", (slope >= 1) & (slope < 5), 900)], by, ts),
    ]
    mismatch = windows.increase(metrics.filter("metric = 'receipt_mismatches_total'"), by, ts, "value", 600, spread_s=SPAN_S)
    parts.append(evaluate(mismatch, [Rule("count_mismatch", F.col("increase") > 0)]))
    errors = windows.increase(metrics.filter("metric = 'parse_errors_total'"), [*by, "labels_key"], ts, "value", 600, spread_s=SPAN_S)
    errors = errors.groupBy(*by, "labels_key", ts).agg(F.sum("increase").alias("increase"))
    parts.append(evaluate(errors, [Rule("parse_errors", F.col("increase") > 0)]))
    health = pivoted(metrics, ["source_enabled", "source_read_ok", "source_schema_ok"], [*by, "labels_key"], ts)
    failed = (F.col("source_enabled") == 1) & ((F.col("source_read_ok") == 0) | (F.col("source_schema_ok") == 0))
    parts.append(evaluate(health, [Rule("source_failed", failed, 600)], [*by, "labels_key"], ts))
    files = pivoted(metrics, ["tmp_stale_bytes", "tmp_scan_complete"], by, ts)
    parts.append(evaluate(files, [Rule("stale_tmp", (F.col("tmp_stale_bytes") >= 64 << 20) & (F.col("tmp_scan_complete") == 1), 900)], by, ts))
    process = pivoted(metrics, ["node_process_up", "visor_process_up", "process_source_ok"], by, ts)
    ok = F.col("process_source_ok") == 1
    parts.append(evaluate(process, [Rule("node_absent", (F.col("node_process_up") == 0) & ok, 120, "critical"), Rule("visor_absent", (F.col("visor_process_up") == 0) & ok, 120, "critical")], by, ts))
    fallback = pivoted(metrics, ["validator_api_up", "validator_cache_stale"], by, ts)
    parts.append(evaluate(fallback, [Rule("stale_fallback", (F.col("validator_api_up") == 0) & (F.col("validator_cache_stale") == 1), 300)], by, ts))
    out = None
    for p in parts:
        p = p.select(*by, ts, "rule", "severity")
        out = p if out is None else out.unionByName(p)
    return out
