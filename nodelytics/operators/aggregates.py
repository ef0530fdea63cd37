"""Aggregations: counters, histograms, latest values, conditional totals, rates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import nonneg_sub


def counter(df: DataFrame, labels: Sequence[str], value: str | None = None, name: str = "n") -> DataFrame:
    """Sum of increments by labels; without a value, rows count."""
    return df.groupBy(*labels).agg((F.sum(value) if value else F.count(F.lit(1))).alias(name))


def exponential_bounds(start: float, factor: float, n: int) -> list[float]:
    return [start * factor**i for i in range(n)]


def explicit_histogram(df: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str], total: Column | None = None) -> DataFrame:
    """Cumulative counts by inclusive upper bound, with ``+Inf``, and the sum; one pass, one shuffle."""
    v = F.col(value)
    cells = [F.sum((v <= b).cast("long")).alias(f"_b{i}") for i, b in enumerate(bounds)]
    made = df.filter(v.isNotNull()).groupBy(*labels).agg(*cells, F.count(F.lit(1)).alias("_count"), (total if total is not None else F.sum(v)).alias("total"))
    rows = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_count").alias("bucket")))
    return made.select(*labels, F.inline(rows), F.col("_count").alias("n"), "total")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the greatest ``order`` per key, by partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def conditional_totals(df: DataFrame, value: Column, predicates: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Sum and count of the rows of each predicate, in one pass."""
    out = []
    for name, p in predicates.items():
        out += [F.coalesce(F.sum(F.when(p, value)), F.lit(0)).alias(f"{name}_sum"), F.sum(F.when(p, 1).otherwise(0)).alias(f"{name}_n")]
    return df.groupBy(*by).agg(*out)


def distinct_positive(df: DataFrame, by: Sequence[str], key: str, value: Column) -> DataFrame:
    """Distinct keys with a positive value; two-step, so one group's keys are spread over tasks."""
    return df.filter(value > 0).select(*by, key).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rollup_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """GROUPING SETS; the column ``level`` has the grouping id."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(F.grouping_id().alias("level"), *aggregates)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight; rows without weight carry none, and no weight at all gives 0."""
    return F.coalesce(F.sum(F.when(weight > 0, value * weight)) / F.nullif(F.sum(F.when(weight > 0, weight)), F.lit(0)), F.lit(0.0))


def safe_sum(value: Column) -> Column:
    """A sum that is null unless it is finite."""
    total = F.sum(value)
    return F.when(~F.isnan(total) & (F.abs(total) < float("inf")), total)


def sum_positive(df: DataFrame, by: Sequence[str], delta: Column, name: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.when(delta > 0, delta)), F.lit(0)).alias(name))


def poll_peak(df: DataFrame, keys: Sequence[str], ts: str, value: str, interval: str) -> DataFrame:
    """Greatest value per interval and key."""
    w = F.window(F.col(ts).cast("timestamp"), interval)
    return df.groupBy(w.alias("_w"), *keys).agg(F.max(value).alias("peak")).select(F.col("_w.start").alias("window_start"), *keys, "peak")


def participation_rate(blocks: DataFrame, scope: Sequence[str], order: Sequence[str], signers: str, rows: int = 100) -> DataFrame:
    """Share, times 100, of the latest ``rows`` blocks of a scope in which a signer occurs; blocks without signers count."""
    rank = Window.partitionBy(*scope).orderBy(*[F.desc(c) for c in order])
    last = blocks.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= rows)
    size = last.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    seen = last.select(*scope, F.explode(F.array_distinct(signers)).alias("signer")).groupBy(*scope, "signer").agg(F.count(F.lit(1)).alias("_k"))
    return seen.join(size, list(scope)).select(*scope, "signer", (F.col("_k") * 100.0 / F.col("_n")).alias("rate"))


def daily_representative(df: DataFrame, day: str, height: str) -> DataFrame:
    """Per day the greatest height and its number of rows."""
    return df.groupBy(day, height).agg(F.count(F.lit(1)).alias("n_rows")).groupBy(day).agg(F.max(F.struct(height, "n_rows")).alias("_x")).select(day, "_x.*")


def unique_seen(df: DataFrame, scope: Sequence[str], key: str, ts: str, as_of: Column, windows: Mapping[str, int]) -> DataFrame:
    """Distinct keys seen within each window (seconds) before ``as_of``: keys are reduced to their last sight first."""
    last = df.filter(F.col(ts) <= as_of).groupBy(*scope, key).agg(F.max(ts).alias("_last"))
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))
    return last.groupBy(*scope).agg(*[F.sum((age <= s * 1_000_000).cast("long")).alias(name) for name, s in windows.items()])


def block_action_stats(blocks: DataFrame, keys: Sequence[str], actions: str) -> DataFrame:
    """Per block, from an array of ``(type, operations)``: actions, operations, and orders (operations of order types)."""
    a = F.col(actions)
    add = lambda pick: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + pick(x))
    return blocks.select(*keys, F.size(a).alias("actions"), add(lambda x: x["operations"]).alias("operations"), add(lambda x: F.when(x["type"].isin("order", "twapOrder"), x["operations"]).otherwise(0)).alias("orders"))


def response_stats(df: DataFrame, keys: Sequence[str], requests: Column, statuses: str) -> DataFrame:
    """Per record: response coverage, count relation, and statuses ok, err, other."""
    from ..functions.scalars import relation

    s = F.col(statuses)
    count = lambda p: F.size(F.filter(s, p))
    return df.select(
        *keys, F.when(s.isNull(), "unavailable").otherwise("available").alias("coverage"), relation(F.size(s), requests).alias("relation"),
        count(lambda x: x == "ok").alias("ok"), count(lambda x: x == "err").alias("err"), count(lambda x: ~F.coalesce(x.isin("ok", "err"), F.lit(False))).alias("other"),
    )


def priority_fee(kind: Column, max_priority: Column, max_fee: Column, gas_price: Column, base: Column, sub: Callable[[Column, Column], Column] = nonneg_sub) -> Column:
    """Effective priority fee of a transaction over the base fee; ``sub`` is the difference, at least zero, of the type of number."""
    modern = F.when(max_priority.isNotNull() & max_fee.isNotNull(), F.least(max_priority, sub(max_fee, base)))
    return F.when(kind == "Eip1559", modern).when(kind.isin("Legacy", "Eip2930") & gas_price.isNotNull(), sub(gas_price, base))


def block_priority_fee(fees: Column, effective: Column, base: Column, sub: Callable[[Column, Column], Column] = nonneg_sub) -> Column:
    """The maximum of one block from the arrays of its transactions' fees and receipts' effective prices; null if none is known.

    If every transaction has a receipt with an effective price, the receipts decide; else the larger of both.
    """
    known = F.filter(effective, lambda x: x.isNotNull())
    of_receipts = F.array_max(F.transform(known, lambda x: sub(x, base)))
    whole = (F.size(effective) == F.size(fees)) & (F.size(known) == F.size(effective))
    return F.when(whole, of_receipts).otherwise(F.greatest(F.array_max(fees), of_receipts))


def max_priority_fee(txs: DataFrame, receipts: DataFrame, key: str, sub: Callable[[Column, Column], Column] = nonneg_sub, zero: Column | None = None) -> DataFrame:
    """``block_priority_fee`` over tables ``txs (key, fee)`` and ``receipts (key, effective, base)``.

    Without a known fee the maximum is 0 and ``has_fee`` false.
    """
    zero = F.lit(0).cast("decimal(38,0)") if zero is None else zero
    a = txs.groupBy(key).agg(F.count(F.lit(1)).alias("n_tx"), F.max("fee").alias("tx_fee"))
    b = receipts.groupBy(key).agg(F.count(F.lit(1)).alias("n_rec"), F.count("effective").alias("n_eff"), F.max(F.when(F.col("effective").isNotNull(), sub(F.col("effective"), F.col("base")))).alias("rec_fee"))
    whole = (F.col("n_rec") == F.col("n_tx")) & (F.col("n_eff") == F.col("n_rec"))
    best = F.when(whole, F.col("rec_fee")).otherwise(F.greatest("tx_fee", "rec_fee"))
    return a.join(b, key, "full").select(key, F.coalesce(best, zero).alias("max_fee"), best.isNotNull().alias("has_fee"))


def receipt_outcomes(df: DataFrame, by: Sequence[str], success: str, mismatch: Column, height: str) -> DataFrame:
    """Success, failed and unknown counts, mismatched rows and the greatest height with one."""
    s = F.col(success)
    return df.groupBy(*by).agg(F.sum(F.when(s, 1).otherwise(0)).alias("success"), F.sum(F.when(~s, 1).otherwise(0)).alias("failed"), F.sum(s.isNull().cast("long")).alias("unknown"), F.sum(F.when(mismatch, 1).otherwise(0)).alias("mismatches"), F.max(F.when(mismatch, F.col(height))).alias("last_mismatch"))


def nested_outcomes(groups: Column, ok) -> Column:
    """``(ok, other)`` counts over an array of arrays."""
    flat = F.flatten(groups)
    good = F.size(F.filter(flat, ok))
    return F.struct(good.alias("ok"), (F.size(flat) - good).alias("other"))


def disk_usage(inventory: DataFrame, by: Sequence[str], scopes: Mapping[str, str]) -> DataFrame:
    """Apparent bytes, and allocated bytes once per (device, inode), of each ``by`` inside each of the overlapping path scopes."""
    inside = F.array_compact(F.array(*[F.when(F.col("path").startswith(p), F.lit(s)) for s, p in scopes.items()]))
    rows = inventory.filter("is_regular").select(*by, "size", "alloc_bytes", "device", "inode", F.explode(inside).alias("scope"))
    # one shuffle: sums of a file's links first, then of files
    files = rows.groupBy(*by, "scope", "device", "inode").agg(F.sum("size").alias("s"), F.max("alloc_bytes").alias("a"))
    return files.groupBy(*by, "scope").agg(F.sum("s").alias("apparent_bytes"), F.sum("a").alias("allocated_bytes"))


def classed_file_stats(inventory: DataFrame, by: Sequence[str], as_of: Column, stale_s: int = 86_400) -> DataFrame:
    """Files, bytes, and files older than the limit; times in the future count as files but never as newest."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp"))
    old = (age > stale_s * 1_000_000).cast("long")
    return inventory.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(old).alias("stale"), F.max(F.when(age >= 0, F.col("mtime"))).alias("newest"))


def sentinel_window(inventory: DataFrame, scope: Sequence[str], date: str, height: str, mtime: str, dates: int = 2) -> DataFrame:
    """Over the newest dates: files, the greatest height, and its newest time."""
    days = inventory.select(*scope, date).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc(date)))).filter(F.col("_r") <= dates)
    rows = inventory.join(days.drop("_r"), [*scope, date], "left_semi")
    return rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("files"), F.max(F.struct(height, mtime)).alias("_x")).select(*scope, "files", "_x.*")


def retained_markers(inventory: DataFrame, scope: Sequence[str], start: Column, mtime: str) -> DataFrame:
    return inventory.withColumn("_start", start).filter("_start is not null").groupBy(*scope).agg(F.count(F.lit(1)).alias("markers"), F.max("_start").alias("newest_start"), F.max(mtime).alias("newest_activity"))


def with_census(owners: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """Each owner with every combination of the closed lists of values."""
    for name, each in values.items():
        owners = owners.select("*", F.explode(F.array(*[F.lit(x) for x in each])).alias(name))
    return owners


def zero_filled(df: DataFrame, census: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """``df`` on every row of a closed census, zero where it has none; rows outside the census go."""
    return census.join(df, list(keys), "left").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def log_volume(lines: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """Lines and bytes (with the newline) of the newest date of each group."""
    per = lines.groupBy(*by, date).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    return latest_per_key(per, by, [date])


def snapshot_sizes(pairs: Column) -> Column:
    """Map of sizes and the oldest age from an array of ``(name, size, age)``."""
    return F.struct(F.map_from_arrays(F.transform(pairs, lambda p: p["name"]), F.transform(pairs, lambda p: p["size"])).alias("sizes"), F.array_max(F.transform(pairs, lambda p: p["age"])).alias("oldest"))


def socket_census(rows: DataFrame, by: Sequence[str], ports: Sequence[int], states: Sequence[str]) -> DataFrame:
    """Sockets of each ``by`` by (port, side, state), zero-filled; the local port is tested first and each row counts once."""
    local, remote = F.col("local_port").isin(list(ports)), F.col("remote_port").isin(list(ports))
    side = F.when(local, "local").when(remote, "remote")
    found = rows.select(*by, F.when(local, F.col("local_port")).otherwise(F.col("remote_port")).alias("port"), side.alias("side"), "state")
    # rows of no port still name their node
    counted = found.groupBy(*by, "port", "side", "state").agg(F.count(F.lit(1)).alias("n"))
    every = with_census(counted.select(*by).distinct(), {"port": ports, "side": ("local", "remote"), "state": states})
    return zero_filled(counted, every, [*by, "port", "side", "state"], ["n"])


def child_summary(df: DataFrame, by: Sequence[str], verified: str, connections: str, cap: int = 16) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.col(verified).cast("long")).alias("verified"), F.sum((~F.col(verified)).cast("long")).alias("unverified"), F.sum(connections).alias("connections"), F.greatest(F.lit(0), F.count(F.lit(1)) - cap).alias("overflow"))


def event_outcomes(df: DataFrame, event: str, status: str, items: str) -> DataFrame:
    return df.groupBy(event, status).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(items), F.lit(0)).alias("items"))


def select_oldest(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Per name: candidates, and the one of the least ``order``."""
    rest = [c for c in df.columns if c != name]
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("eligible"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(name, "eligible", "_x.*")
