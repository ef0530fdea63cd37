"""Ordered operators with window functions: steps, rates, islands, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _over(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def inter_arrival(df: DataFrame, by: Sequence[str], ts: str, tie: str, name: str = "gap_ms") -> DataFrame:
    """Milliseconds since the row before; the first of a key has none."""
    return df.withColumn(name, (micros(ts) - F.lag(micros(ts)).over(_over(by, [ts, tie]))) / 1000.0)


def advancing_interval(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, name: str = "gap_ms") -> DataFrame:
    """Milliseconds since the greatest time before, only where the time advances; a late row does not move the clock."""
    before = F.max(micros(ts)).over(_over(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.when(micros(ts) > before, (micros(ts) - before) / 1000.0))


def positive_step(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "step") -> DataFrame:
    """Rows whose value exceeds the one before, and by how much."""
    step = F.col(value) - F.lag(value).over(_over(by, order))
    return df.withColumn(name, step).filter(F.col(name) > 0)


def positive_delta(df: DataFrame, by: Sequence[str], epoch: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Increases of cumulative values within an epoch, each value by itself; a new epoch starts anew."""
    w = _over([*by, *epoch], order)
    return df.withColumns({f"{v}_delta": F.greatest(F.lit(0.0), F.coalesce(F.col(v) - F.lag(v).over(w), F.lit(0.0))) for v in values})


def _with_spans(df: DataFrame, by: Sequence[str], made: DataFrame, name: str) -> DataFrame:
    """``df`` and the column ``name`` of ``made``, which has a row for each key and span ``_b``."""
    right = made.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb"), name)
    same = F.col("_b") == F.col("_kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(right, same, "left").drop("_kb", *[f"_k{i}" for i in range(len(by))])


def _in_range(rows: DataFrame, by: Sequence[str], window_s: int, spread_s: int | None, name: str, value) -> DataFrame:
    """``value(window)`` over the rows of ``_t`` up to ``window_s`` seconds before.

    With ``spread_s``, a key's rows are dealt to spans of time of that length, each with the window's rows before it.
    """
    low = window_s * 1_000_000
    if spread_s is None:
        return rows.withColumn(name, value(Window.partitionBy(*by).orderBy("_t").rangeBetween(-low, 0)))
    width = max(spread_s * 1_000_000, low, 1)
    own, last = F.floor(F.col("_t") / width), F.floor((F.col("_t") + low) / width)
    dealt = rows.withColumn("_own", own).withColumn("_span", F.explode(F.array_distinct(F.array(own, last))))
    made = dealt.withColumn(name, value(Window.partitionBy(*by, "_span").orderBy("_t").rangeBetween(-low, 0)))
    return made.filter("_own = _span").drop("_own", "_span")


def increase(df: DataFrame, by: Sequence[str], ts: str, value: str, window_s: int, tie: str | None = None, name: str = "increase", spread_s: int | None = None) -> DataFrame:
    """Increase of a counter over the window before each row; a fall is a reset and counts from zero.  No extrapolation.

    ``spread_s`` deals a key with many rows to spans of time of that length.
    """
    order = [ts] + ([tie] if tie else [])
    if spread_s is None:
        rows = df.withColumn("_p", F.lag(value).over(_over(by, order)))
    else:
        spans = df.withColumn("_b", F.floor(micros(ts) / (spread_s * 1_000_000)))
        ends = spans.groupBy(*by, "_b").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
        ends = ends.withColumn("_before", F.lag("_end").over(_over(by, ["_b"])))
        w = _over([*by, "_b"], order)
        inside = _with_spans(spans, by, ends, "_before")
        rows = inside.withColumn("_p", F.when(F.row_number().over(w) == 1, F.col(f"_before.{value}")).otherwise(F.lag(value).over(w))).drop("_before", "_b")
    before = F.col("_p")
    delta = F.when(before.isNull(), F.lit(0).cast("double")).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    rows = rows.withColumn("_d", delta).withColumn("_t", micros(ts))
    return _in_range(rows, by, window_s, spread_s, name, lambda w: F.sum("_d").over(w)).drop("_d", "_t", "_p")


def deriv(df: DataFrame, by: Sequence[str], ts: str, value: str, window_s: int, name: str = "slope", spread_s: int | None = None) -> DataFrame:
    """Least-squares slope per second over the window before each row; ``spread_s`` as of ``increase``."""
    rows = df.withColumn("_t", micros(ts))
    if spread_s is None:
        rows = rows.withColumn("_first", F.min("_t").over(Window.partitionBy(*by)))
    else:
        rows = _with_spans(rows.withColumn("_b", F.lit(0)), by, rows.groupBy(*by).agg(F.min("_t").alias("_first")).withColumn("_b", F.lit(0)), "_first").drop("_b")
    rows = rows.withColumn("_x", (F.col("_t") - F.col("_first")) / 1e6)
    return _in_range(rows, by, window_s, spread_s, name, lambda w: F.regr_slope(F.col(value), F.col("_x")).over(w)).drop("_t", "_x", "_first")


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], new: Column, name: str = "island") -> DataFrame:
    """Number of rows so far at which ``new`` holds: equal within an unbroken run."""
    return df.withColumn(name, F.sum(F.coalesce(new, F.lit(False)).cast("long")).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def hold_for(df: DataFrame, by: Sequence[str], ts: str, tie: str, condition: Column, seconds: int, name: str = "firing", spread_s: int | None = None) -> DataFrame:
    """True where the condition has held at every row for the duration.

    With ``spread_s``, runs are found inside spans of time of that length, and the start of the run that is open at a span's end is carried on.
    """
    rows = df.withColumn("_c", F.coalesce(condition, F.lit(False)))
    keys = list(by)
    if spread_s is not None:
        rows, keys = rows.withColumn("_b", F.floor(micros(ts) / (spread_s * 1_000_000))), [*by, "_b"]
    rows = islands(rows, keys, [ts, tie], ~F.col("_c"), "_i")
    held = F.when(F.col("_c"), micros(ts))
    start = F.min(held).over(Window.partitionBy(*keys, "_i"))
    if spread_s is not None:
        runs = rows.groupBy(*keys, "_i").agg(F.min(held).alias("_start"))
        spans = runs.groupBy(*keys).agg(F.max_by(F.struct("_start"), "_i").alias("_tail"), F.max("_i").alias("_n")).withColumn("_tail", F.col("_tail._start"))
        w = _over(by, ["_b"])
        spans = islands(spans, by, ["_b"], F.col("_n") > 0, "_g")
        spans = spans.withColumn("_run", F.min("_tail").over(_over([*by, "_g"], ["_b"]).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_open", F.lag("_run").over(w))
        rows = _with_spans(rows, by, spans, "_open")
        start = F.when(F.col("_i") == 0, F.least(start, F.col("_open"))).otherwise(start)
    return rows.withColumn(name, F.col("_c") & (micros(ts) - start >= seconds * 1_000_000)).drop("_c", "_i", "_b", "_open")


def snapshot_index(df: DataFrame, scope: Sequence[str], ts: str, max_gap: int | None = None, as_number: Column | None = None) -> DataFrame:
    """Distinct snapshots of a scope with a dense index, and an epoch that a gap over ``max_gap`` ends (in units of ``as_number``, else microseconds)."""
    snapshots = df.select(*scope, ts).distinct()
    w = _over(scope, [ts])
    number = as_number if as_number is not None else micros(ts)
    gap = number - F.lag(number).over(w)
    rows = snapshots.withColumn("idx", F.row_number().over(w))
    if max_gap is None:
        return rows.withColumn("epoch", F.lit(0).cast("long"))
    return rows.withColumn("_new", gap > max_gap).withColumn("epoch", F.sum(F.coalesce(F.col("_new"), F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def consecutive_presence(df: DataFrame, scope: Sequence[str], key: str, ts: str, max_gap: int | None = None, as_number: Column | None = None) -> DataFrame:
    """Keys present in two consecutive snapshots of one epoch, with the second snapshot."""
    index = snapshot_index(df, scope, ts, max_gap, as_number)
    rows = df.select(*scope, key, ts).distinct().join(index, [*scope, ts])
    w = Window.partitionBy(*scope, key, "epoch").orderBy("idx")
    return rows.withColumn("_p", F.lag("idx").over(w)).filter(F.col("_p") == F.col("idx") - 1).drop("_p")


def membership_tenure(df: DataFrame, scope: Sequence[str], key: str, ts: str, max_gap: int | None = None, as_number: Column | None = None) -> DataFrame:
    """Unbroken membership of a key up to each snapshot: snapshots, and the first of the run."""
    index = snapshot_index(df, scope, ts, max_gap, as_number)
    rows = df.select(*scope, key, ts).distinct().join(index, [*scope, ts])
    w = Window.partitionBy(*scope, key, "epoch").orderBy("idx")
    runs = rows.withColumn("_run", F.col("idx") - F.row_number().over(w))
    r = Window.partitionBy(*scope, key, "epoch", "_run").orderBy("idx")
    return runs.withColumn("tenure", F.row_number().over(r)).withColumn("since", F.min(ts).over(r)).drop("_run")


def change_count(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Changes of a value per key; the first value is none."""
    before = F.lag(value).over(_over(by, order))
    return df.withColumn("_c", (before.isNotNull() & (before != F.col(value))).cast("long")).groupBy(*by).agg(F.sum("_c").alias("changes"))


def window_duration(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Seconds between consecutive distinct times; rows of one time share it."""
    times = df.select(*by, ts).distinct()
    times = times.withColumn("duration_s", (micros(ts) - F.lag(micros(ts)).over(_over(by, [ts]))) / 1e6)
    return df.join(times, [*by, ts])


def last_good(df: DataFrame, by: Sequence[str], order: Sequence[str], ok: Column, payload: Sequence[str], prefix: str = "good_") -> DataFrame:
    """The last complete payload at each row; failed rows keep it."""
    w = _over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{prefix}{c}": F.last(F.when(ok, F.col(c)), ignorenulls=True).over(w) for c in payload})


def sticky_topn(df: DataFrame, scope: Sequence[str], key: str, order: Sequence[str], n: int, name: str = "label") -> DataFrame:
    """The first ``n`` distinct keys of a scope keep their name; later ones are ``other``."""
    first = df.groupBy(*scope, key).agg(F.min(F.struct(*order)).alias("_f"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy("_f", key)) if scope else F.row_number().over(Window.orderBy("_f", key)))
    early = ranked.filter(F.col("_r") <= n).select(*scope, key)
    joined = df.join(early.withColumn("_early", F.lit(True)), [*scope, key], "left")
    return joined.withColumn(name, F.when(F.col("_early"), F.col(key).cast("string")).otherwise("other")).drop("_early")


def lags(df: DataFrame, head: str, others: Sequence[str]) -> DataFrame:
    """Differences of one column to others in a status row; null where either is missing."""
    return df.withColumns({f"{head}_minus_{c}": F.col(head) - F.col(c) for c in others})


#: Snapshots in a block of ``ewma``: powers over a block stay far inside the range of a double.
EWMA_BLOCK = 256


def ewma(df: DataFrame, scope: Sequence[str], key: str, idx: str, value: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean per key at each of its snapshots: absent snapshots count as zero.

    Closed form in blocks of ``EWMA_BLOCK`` snapshots: within a block the weighted sum so far, scaled
    by powers of the distance to the block's start; before it, the decayed sums of the two blocks in
    which the key was seen last (older ones are below the resolution of a double).  For a mean that
    starts anew after a gap, let the epoch of ``snapshot_index`` be part of the scope.
    """
    keep = 1.0 - alpha
    at, by = F.col(idx).cast("long"), [*scope, key]
    rows = df.withColumn("_block", F.floor(at / EWMA_BLOCK)).withColumn("_in", F.pmod(at, F.lit(EWMA_BLOCK)).cast("double"))
    scaled = F.col(value) * alpha * F.pow(F.lit(1 / keep), F.col("_in"))
    w = Window.partitionBy(*by, "_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(scaled).over(w) * F.pow(F.lit(keep), F.col("_in")))
    # of each block: the mean at its last snapshot, were there no block before it
    ends = rows.groupBy(*by, "_block").agg((F.sum(scaled) * keep ** (EWMA_BLOCK - 1)).alias("_end"))
    order = Window.partitionBy(*by).orderBy("_block")

    def carried(n: int) -> Column:
        steps = (F.col("_block") - F.lag("_block", n).over(order) - 1) * EWMA_BLOCK
        return F.coalesce(F.lag("_end", n).over(order) * F.pow(F.lit(keep), steps.cast("double")), F.lit(0.0))

    before = ends.withColumn("_before", carried(1) + carried(2)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_b"), "_before")
    same = F.col("_block") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(before, same).withColumn("ewma", F.col("_own") + F.col("_before") * F.pow(F.lit(keep), F.col("_in") + 1))
    return joined.select(*df.columns, "ewma")


def ewma_pruned(df: DataFrame, scope: Sequence[str], key: str, idx: str, value: str, alpha: float, prune: float = 1e-9) -> DataFrame:
    """``ewma`` of a bounded set of keys: a key whose mean falls below ``prune`` while it is absent starts anew, and a snapshot without a positive value clears all.

    Both are cuts of a key's rows into segments, so the closed form stays: epochs end with cleared snapshots, and an absence
    cuts where the mean before it, decayed over it, is below the limit.  Rows of a cleared snapshot have no mean.
    """
    keep, names = 1.0 - alpha, [f"_s{i}" for i in range(len(scope))]
    snapshots = df.groupBy(*[F.col(c).alias(n) for c, n in zip(scope, names, strict=True)], F.col(idx).alias("_at")).agg((F.coalesce(F.max(value), F.lit(0.0)) <= 0).alias("_clear"))
    snapshots = snapshots.withColumn("_epoch", F.sum(F.col("_clear").cast("long")).over(_over(names, ["_at"]).rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col(idx) == F.col("_at")
    for c, n in zip(scope, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    rows = df.join(snapshots, same).drop("_at", *names)
    live = ewma(rows.filter(~F.col("_clear")), [*scope, "_epoch"], key, idx, value, alpha)
    w = _over([*scope, "_epoch", key], [idx])
    left = F.lag("ewma").over(w) * F.pow(F.lit(keep), (F.col(idx) - F.lag(idx).over(w) - 1).cast("double"))
    cut = islands(live.withColumn("_cut", F.coalesce(left < prune, F.lit(False))).drop("ewma"), [*scope, "_epoch", key], [idx], F.col("_cut"), "_segment")
    made = ewma(cut, [*scope, "_epoch", "_segment"], key, idx, value, alpha)
    return made.select(*df.columns, "ewma").unionByName(rows.filter("_clear").select(*df.columns, F.lit(None).cast("double").alias("ewma")))


def retire_idle(df: DataFrame, by: Sequence[str], ts: str, as_of: Column, idle_s: int) -> DataFrame:
    """Rows of the keys that were seen within the time before ``as_of``; keys idle for longer are retired with all their rows."""
    last = df.groupBy(*by).agg(F.max(ts).alias("_last")).filter(micros(as_of) - micros("_last") <= idle_s * 1_000_000)
    return df.join(last.drop("_last"), list(by), "left_semi")
