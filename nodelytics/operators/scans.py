"""Running values along the order of a key, however many rows the key has.

A window over a key puts all its rows into one task.  Here the rows are dealt to blocks by ranges of key and time, which
Spark samples so that each holds about ``BLOCK_ROWS`` rows whatever the times are; a window runs inside each block, the
values at the blocks' ends are carried along the blocks of a key (a small table), and each block adds what came before it.
So one key is spread over as many tasks as it has blocks.  Rows of one key and time stay in one block.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import Scratch

#: Rows of a block, about, and how many smaller ones there may be: Spark samples for each, and its ends are carried.
BLOCK_ROWS, SMALL_BLOCKS = 100_000, 256


def with_block(df: DataFrame, by: Sequence[str], us: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df``, written, and ``_block``: ascending along key and time; blocks of fewer than ``BLOCK_ROWS`` only while they are few."""
    count = df.count()
    n = max(min(count // rows, SMALL_BLOCKS), count // BLOCK_ROWS) + 1
    if n == 1:
        return df.withColumn("_block", F.lit(0))
    return Scratch(df.sparkSession, "blocks").write(df.repartitionByRange(n, *by, us).withColumn("_block", F.spark_partition_id()), "rows")


def running(df: DataFrame, by: Sequence[str], us: str, order: Sequence[str], values: dict[str, tuple[str, Column]], before: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` and, per name of ``values``, the running value of a column in the order of ``(us, *order)`` of each key.

    A value is ``("last", column)``: the last one that is not null, or ``("max", column)`` and ``("min", column)``.
    ``before``: without the row itself.
    """
    if not by:
        return running(df.withColumn("_all", F.lit(1)), ["_all"], us, order, values, before, rows).drop("_all")
    cut = with_block(df, by, us, rows)
    taken = [f"_v{i}" for i in range(len(values))]
    cut = cut.withColumns({t: c for t, (_, c) in zip(taken, values.values(), strict=True)})
    keys = [*by, "_block"]
    upto = Window.partitionBy(*keys).orderBy(us, *order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    fold = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "min": F.min}
    inside = cut.withColumns({f"_i{t}": fold[kind](F.col(t)).over(upto) for t, (kind, _) in zip(taken, values.values(), strict=True)})
    at = F.struct(us, *order)
    whole = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), at)), "max": F.max, "min": F.min}
    ends = cut.groupBy(*keys).agg(*[whole[kind](F.col(t)).alias(t) for t, (kind, _) in zip(taken, values.values(), strict=True)])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_b"), *[fold[kind](F.col(t)).over(earlier).alias(f"_c{t}") for t, (kind, _) in zip(taken, values.values(), strict=True)])
    same = F.col("_block") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = inside.join(carried, same)
    join = {"last": lambda i, c: F.coalesce(i, c), "max": F.greatest, "min": F.least}
    made = [join[kind](F.col(f"_i{t}"), F.col(f"_c{t}")).alias(name) for t, (name, (kind, _)) in zip(taken, values.items(), strict=True)]
    return joined.select(*df.columns, *made)


def asof(df: DataFrame, reference: DataFrame, by: Sequence[str], us: str, value: str, name: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` and ``name``: the value of the latest row of ``reference`` that is not later; of rows of one time the greatest value."""
    left = df.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(reference.schema[value].dataType)})
    right = reference.groupBy(*by, us).agg(F.max(value).alias("_value")).withColumn("_side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    return running(both, by, us, ["_side"], {name: ("last", F.col("_value"))}, rows=rows).filter("_side = 1").drop("_side", "_value")


def last_good(df: DataFrame, by: Sequence[str], us: str, order: Sequence[str], good: Column, payload: Sequence[str], max_age_us: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` and ``last_good``: payload and time of the last good row up to this one, while it is not older than the limit."""
    kept = F.when(good, F.struct(*payload, F.col(us).alias("us")))
    made = running(df, by, us, order, {"last_good": ("last", kept)}, rows=rows)
    return made.withColumn("last_good", F.when(F.col(us) - F.col("last_good.us") <= max_age_us, F.col("last_good")))


def advancing(df: DataFrame, by: Sequence[str], us: str, order: Sequence[str], column: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows whose column exceeds that of all rows before, with ``gap_us``: the time since the advance before."""
    best = running(df, by, us, order, {"_best": ("max", F.col(column))}, before=True, rows=rows)
    steps = best.filter(F.col("_best").isNull() | (F.col(column) > F.col("_best"))).drop("_best")
    return running(steps, by, us, order, {"_prev": ("last", F.col(us))}, before=True, rows=rows).withColumn("gap_us", F.col(us) - F.col("_prev")).drop("_prev")


class Heads:
    """The chains through the rows of a block, whatever accepted row came before it.

    A row that some earlier row equals or exceeds in every column is never accepted.  Any other row is accepted by the chains whose last rows it exceeds:
    from then on they are one.  The ends of the chains are kept in the order of the first column, along which the last column falls if there are two.
    """

    def __init__(self):
        self.rows: list[tuple[float, ...]] = []  # accepted first by some chain
        self.into: list[int | None] = []  # the row that follows
        self.ends: list[tuple[tuple[float, ...], int]] = []  # (first column, - the second), row

    def add(self, row: tuple[float, ...]) -> None:
        n = len(self.rows)
        if len(row) <= 2:
            a, b = row[0], row[-1]
            low = bisect.bisect_left(self.ends, ((a,),))
            if low < len(self.ends) and self.rows[self.ends[low][1]][-1] >= b:
                return
            first = bisect.bisect_right(self.ends, -b, 0, low, key=lambda e: e[0][1])
            for _, i in self.ends[first:low]:
                self.into[i] = n
            self.ends[first:low] = []
            bisect.insort(self.ends, ((a, -b), n))
        else:
            kept = []
            for e in self.ends:
                end = self.rows[e[1]]
                if all(x >= y for x, y in zip(end, row, strict=True)):
                    return
                if all(x < y for x, y in zip(end, row, strict=True)):
                    kept.append(e[1])
            for i in kept:
                self.into[i] = n
            self.ends = [e for e in self.ends if self.into[e[1]] is None] + [(row, n)]
        self.rows.append(row)
        self.into.append(None)

    def told(self) -> list[tuple[int, int]]:
        """``(row, end)``, in order: a chain from before goes to the end of the first of these rows that it accepts; those that change nothing are left out."""
        end = list(range(len(self.rows)))
        out: list[tuple[int, int]] = []
        other = len(self.rows)  # the next row told that ends elsewhere than the last one told
        for i in reversed(range(len(self.rows))):
            to = self.into[i]
            if to is not None:
                end[i] = end[to]
            if i and out and to is not None and end[i] == out[-1][1] and to < other:
                continue
            if out and end[i] != out[-1][1]:
                other = out[-1][0]
            out.append((i, end[i]))
        return out[::-1]


def monotone(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """``folds.monotone_filter`` with the rows of a key in blocks: each accepted row exceeds the last accepted one in every column.

    Three passes, however far a row reaches: each block tells which of its rows may be accepted first and where the chain from each ends (``Heads``,
    few rows as chains soon meet), a fold over these finds the row before each block, and each block is folded from it.
    """
    if not by:
        return monotone(df.withColumn("_all", F.lit(1)), ["_all"], order, columns, rows).drop("_all")
    keys, names = [*by, "_block"], [f"_e{i}" for i in range(len(columns))]
    cut = with_block(df, by, order[0], rows)
    kept = cut.columns
    fields = [f for f in cut.schema.fields if f.name in keys]
    values = [f"_v{i}" for i in range(len(columns))]
    doubles = lambda ns: [T.StructField(n, T.DoubleType()) for n in ns]
    told_schema = T.StructType([*fields, T.StructField("_place", T.LongType()), *doubles(values), *doubles(names)])
    ends_schema = T.StructType([*fields, *doubles(names)])
    marked = [f.name for f in fields]
    numbers = cut.withColumns({v: F.col(c).cast("double") for v, c in zip(values, columns, strict=True)})

    def marks(pdf: pd.DataFrame) -> Iterator[tuple]:
        return pdf[marked].astype(object).where(pdf[marked].notna(), None).itertuples(index=False, name=None)

    def tell(parts):
        mark, heads, first = None, None, None

        def told() -> pd.DataFrame:
            made = [(*mark, p, *heads.rows[i], *heads.rows[e]) for p, (i, e) in enumerate(heads.told())]
            if first is not None:  # no chain accepts it but one without a row before
                made.insert(0, (*mark, -1, *first, *first))
            return pd.DataFrame(made, columns=told_schema.names)

        for pdf in parts:
            for m, row in zip(marks(pdf), pdf[values].itertuples(index=False, name=None), strict=True):
                odd = any(v != v for v in row)
                if m != mark:
                    if mark is not None:
                        yield told()
                    mark, heads, first = m, Heads(), row if odd else None
                if not odd:
                    heads.add(row)
        if mark is not None:
            yield told()

    def carry(parts):
        """The last accepted row before each block."""
        mark, base, moved = None, None, False
        for pdf in parts:
            made = []
            for m, row, end in zip(marks(pdf), pdf[values].itertuples(index=False, name=None), pdf[names].itertuples(index=False, name=None), strict=True):
                if m != mark:
                    if mark is None or [v for n, v in zip(marked, m, strict=True) if n != "_block"] != [v for n, v in zip(marked, mark, strict=True) if n != "_block"]:
                        base = None
                    elif base is not None:
                        made.append((*m, *base))
                    mark, moved = m, False
                if not moved and (base is None or all(v > b for v, b in zip(row, base, strict=True))):
                    base, moved = end, True
            yield pd.DataFrame(made, columns=ends_schema.names)

    def fold(parts):
        mark, base, some = None, None, False
        for pdf in parts:
            good = []
            for m, seed, row, start in zip(marks(pdf), pdf["_seed"], pdf[values].itertuples(index=False, name=None), pdf[names].itertuples(index=False, name=None), strict=True):
                if m != mark:
                    mark, base, some = m, None, False
                if seed:
                    base, some = start, True
                    good.append(False)
                    continue
                fits = not some or all(v > b for v, b in zip(row, base, strict=True))
                if fits:
                    base, some = row, True
                good.append(fits)
            yield pdf.loc[good, kept]

    told = numbers.select(*keys, *values, *order).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(tell, told_schema)
    ends = told.repartition(*by).sortWithinPartitions(*keys, "_place").mapInPandas(carry, ends_schema)
    plain = numbers.withColumns({"_seed": F.lit(False), **{n: F.lit(None).cast("double") for n in names}})
    seeded = plain.unionByName(ends.withColumn("_seed", F.lit(True)), allowMissingColumns=True)
    return seeded.repartition(*keys).sortWithinPartitions(*keys, F.desc("_seed"), *order).mapInPandas(fold, cut.schema).drop("_block")
