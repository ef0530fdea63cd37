"""Rankings with closed output size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def topn_plus_other(df: DataFrame, by: Sequence[str], key: str, value: str, n: int, more: Sequence[str] = ()) -> DataFrame:
    """The ``n`` greatest positive keys of a group by summed value (ties by key), and one ``other`` row if its sum is positive."""
    sums = df.groupBy(*by, key).agg(*[F.sum(c).alias(c) for c in (value, *more)])
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), key))
    named = sums.withColumn("_r", rank).withColumn("label", F.when((F.col("_r") <= n) & (F.col(value) > 0), F.col(key).cast("string")).otherwise("other"))
    merged = named.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in (value, *more)])
    return merged.filter((F.col("label") != "other") | (F.col(value) > 0))


def topk_dedup(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The ``k`` greatest keys; a key's larger value counts, never the sum."""
    return df.groupBy(key).agg(F.max(value).alias(value)).orderBy(F.desc(value), key).limit(k)


def first_k(df: DataFrame, by: Sequence[str], key: str, k: int) -> DataFrame:
    """The first ``k`` of each group in key order, and how many more there are."""
    r = Window.partitionBy(*by).orderBy(key)
    ranked = df.withColumn("_r", F.row_number().over(r)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.filter(F.col("_r") <= k).withColumn("overflow", F.greatest(F.lit(0), F.col("_n") - k)).drop("_r", "_n")


def newest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The greatest row of each group by casted order columns."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_x")).select(*by, "_x.*")


def rank_with_ties(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Dense order by value (ties by key), and how many share the greatest value."""
    over = Window.partitionBy(*by)
    return df.withColumn("rank", F.row_number().over(over.orderBy(F.desc(value), key))).withColumn("ties", F.sum((F.col(value) == F.max(value).over(over)).cast("long")).over(over))


def by_recency(df: DataFrame, last_seen: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(last_seen), key)
