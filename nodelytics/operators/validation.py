"""All-or-nothing validation with closed reject reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_failure(checks: Sequence[tuple[str, str, Column]]) -> Column:
    """``(stage, reason)`` of the first check whose condition holds; null if none does."""
    made = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))) for stage, reason, cond in checks]
    return F.coalesce(*made)


def validate(df: DataFrame, checks: Sequence[tuple[str, str, Column]], name: str = "reject") -> DataFrame:
    """``df`` and the first failure of each row; a failing row is rejected as a whole."""
    return df.withColumn(name, first_failure(checks))


def split_rejects(df: DataFrame, name: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the reject column, and the rejects with stage and reason."""
    return df.filter(F.col(name).isNull()).drop(name), df.filter(F.col(name).isNotNull()).select("*", f"{name}.stage", f"{name}.reason").drop(name)


def reject_counts(rejects: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rejects.groupBy(*keys, "stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def reject_if_any(items: Column, bad) -> Column:
    """Condition: some nested item is bad (a null array is bad as well)."""
    return F.coalesce(F.exists(items, bad), F.lit(True))


def reject_generation(df: DataFrame, generation: Sequence[str], bad: Column) -> DataFrame:
    """Rows of the generations in which no row is bad."""
    over = Window.partitionBy(*generation)
    return df.withColumn("_bad", F.bool_or(F.coalesce(bad, F.lit(True))).over(over)).filter(~F.col("_bad")).drop("_bad")


def unique_within(df: DataFrame, generation: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Rows of the generations whose keys are unique: two aggregations, so a large generation is no single group."""
    twice = df.groupBy(*generation, *key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*generation).distinct()
    return df.join(twice, list(generation), "left_anti")


def classify_snapshot(df: DataFrame, generation: Sequence[str], value: str, sentinel: float = 0.4, eps: float = 1e-9) -> DataFrame:
    """One row per generation: ``measured``, ``initializing`` (all zero), ``no_data`` (sentinels only) or ``invalid``, and its measured rows."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0)
    real = ~bad & (F.abs(v - sentinel) > eps)
    state = F.when(F.col("_bad"), "invalid").when(F.col("_zero"), "initializing").when(F.col("measured") == 0, "no_data").otherwise("measured")
    return (
        df.groupBy(*generation)
        .agg(F.bool_or(bad).alias("_bad"), F.bool_and(F.coalesce(v == 0, F.lit(False))).alias("_zero"), F.sum(real.cast("long")).alias("measured"))
        .select(*generation, state.alias("state"), "measured")
    )


def one_hot(df: DataFrame, column: str, states: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each state of a closed list: 1 where the row is in it."""
    cells = F.array(*[F.struct(F.lit(s).alias("state"), F.coalesce((F.col(column) == s).cast("int"), F.lit(0)).alias("on")) for s in states])
    return df.select(*keep, F.inline(cells))


def tagged_failure(tag: Column, shapes: Mapping[str, Column], stage: str = "payload") -> Column:
    """Failure of a tag's own shape check; an unknown tag is no failure."""
    made = None
    for name, good in shapes.items():
        bad = F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit(stage).alias("stage"), F.lit(f"bad_{name}").alias("reason")))
        made = F.when(tag == name, bad) if made is None else made.when(tag == name, bad)
    return made


def allow(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(names)))
