"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

Every node of the tree splits at the weighted median (by bytes) along its widest dimension -
length, language, source - until the leaves reach the wanted size.

The tree works on units.  A unit is all rows of one text, with their bytes and the least of their
languages and sources, so equal texts share a shard.  Only a text whose copies together outweigh a
whole shard is parted, by a hash of the ids.  A place on a dimension is a 60-bit integer, 20 bits
of the value and 40 bits of the unit's number, so units of equal value can be split.

Medians are found by counting bytes in 4096 cells a node and narrowing the median's cell; every
count is aggregated before its shuffle.  A unit of over 1/64 of a shard is heavy; there are at most
64 a shard, so the driver holds their list.  At each split heavy units go left up to half their
bytes, in the order of their places; some are moved where the others' cut could not make up for the
difference; then that cut does, so that sizes stay near equal.

Law ``bytes``.  Null texts weigh one byte, have checksum 0 and count as one text; null metadata has
its own place; empty tables have no shards.  Slots are gapless from 0 in the order of a hash of
(id), then (id, checksum).  Other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, stash, table

LEVELS, DIMENSIONS = 4, 3
#: A split stops where the cell that holds the median has at most this share of the node's bytes.
TOLERANCE = 0.002
#: Units of more than one such part of a shard are heavy; a text heavier than a shard is parted into this many pieces a shard.
HEAVY, PIECES = 64, 8
_CELL_BITS = 12
#: Rows that one task numbers at most, on average.
SLOT_ROWS = 200_000


def _place(value: Column) -> Column:
    """60-bit places of a dimension value in [0, 1], ties by the unit."""
    top = F.least(F.lit((1 << 20) - 1), F.floor(value * (1 << 20))).cast("long")
    return F.shiftleft(top, 40).bitwiseOR(F.shiftrightunsigned(F.col("unit"), 24))


def _unit(column: str) -> Column:
    """A category as a fixed place in [0, 1)."""
    return (F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).cast("double")


def _inline(spark: SparkSession, schema: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of longs from the driver, as a local relation."""
    values = ", ".join("(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows or [(0,) * len(schema)])
    made = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema)})")
    return F.broadcast(made if rows else made.limit(0))


def metadata(docs: DataFrame) -> DataFrame:
    """The narrow rows that the tree works on; the texts are read once and not kept."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long")
    return stash(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text").alias("text_hash"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")), "shard-metadata")


def with_unit(rows: DataFrame, shard_bytes: float) -> DataFrame:
    """``rows`` with the number of their unit; the texts that outweigh a shard (fewer than there are shards) are parted by id."""
    key = ["text_hash", "text_crc32", "size"]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("b")).filter(F.col("b") > shard_bytes)
    heavy = F.broadcast(sums.select(*key, F.ceil(PIECES * F.col("b") / F.lit(shard_bytes)).cast("int").alias("pieces")))
    piece = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))
    return rows.join(heavy, key, "left").withColumn("unit", F.xxhash64(*key, piece)).drop("pieces")


def units(rows: DataFrame) -> DataFrame:
    """``(unit, bytes, d0, d1, d2)``: the units of ``rows`` and their places."""
    made = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.max("size").alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    length = F.least(F.lit(1.0), F.log2(F.col("size").cast("double")) / 40)
    return made.select("unit", "bytes", _place(length).alias("d0"), _place(_unit("lang")).alias("d1"), _place(_unit("source")).alias("d2"))


def weighted_cuts(light: DataFrame, nodes: dict[int, dict]) -> dict[int, int]:
    """The place in each node below which about ``target`` bytes of ``light (node, bytes, d0..)`` lie.

    ``nodes``: per node ``dim``, the bounds ``lo`` (in) and ``hi`` (out), ``bytes`` and ``target``.
    """
    cuts = {k: v["lo"] for k, v in nodes.items() if v["target"] <= 0 or v["lo"] >= v["hi"]}
    live = {k: {**v, "below": 0} for k, v in nodes.items() if k not in cuts}
    while live:
        step = {k: max(1, math.ceil((v["hi"] - v["lo"]) / (1 << _CELL_BITS))) for k, v in live.items()}
        asked = _inline(light.sparkSession, ["node", "dim", "lo", "hi", "step", "need"], [(k, v["dim"], v["lo"], v["hi"], step[k], v["target"] - v["below"]) for k, v in live.items()])
        place = F.element_at(F.array(*[f"d{i}" for i in range(DIMENSIONS)]), F.col("dim").cast("int") + 1)
        inside = light.join(asked, "node").withColumn("place", place).filter("place >= lo and place < hi")
        cells = inside.groupBy("node", "need", F.expr("(place - lo) div step").alias("cell")).agg(F.sum("bytes").alias("b"))
        sums = cells.withColumn("upto", F.sum("b").over(Window.partitionBy("node").orderBy("cell")))
        # the first cell that reaches the target, or else the last
        order = F.struct((F.col("upto") < F.col("need")).alias("short"), F.when(F.col("upto") < F.col("need"), -F.col("cell")).otherwise(F.col("cell")).alias("o"), "cell", "b", "upto")
        found = sums.groupBy("node").agg(F.min(order).alias("x")).collect()  # one line a node
        for r in found:
            k, x, v = r["node"], r["x"], live.pop(r["node"])
            start, w = v["lo"] + x["cell"] * step[k], step[k]
            under = v["below"] + x["upto"] - x["b"]
            if x["b"] <= TOLERANCE * v["bytes"] or w == 1:
                cuts[k] = start if v["target"] - under <= under + x["b"] - v["target"] else start + w
            else:
                live[k] = v | {"lo": start, "hi": min(start + w, v["hi"]), "below": under}
        for k in set(live) - {r["node"] for r in found}:  # no unit lies there
            cuts[k] = live.pop(k)["lo"]
    return cuts


#: Heavy units of a node of which every division is tried.
FEW = 14


def even_out(left: list[dict], right: list[dict], slack: int) -> None:
    """Where the heavy units' difference exceeds what light ones make up for: the most even division of a few, or moves and exchanges while one lowers it."""
    every = [*left, *right]
    if abs(sum(h["bytes"] for h in left) - sum(h["bytes"] for h in right)) > slack and len(every) <= FEW:
        sums = [0]
        for h in every:
            sums += [x + h["bytes"] for x in sums]
        best = min(range(len(sums)), key=lambda i: abs(2 * sums[i] - sums[-1]))
        left[:] = [h for i, h in enumerate(every) if best >> i & 1]
        right[:] = [h for i, h in enumerate(every) if not best >> i & 1]
        return
    while (off := sum(h["bytes"] for h in left) - sum(h["bytes"] for h in right)) and abs(off) > slack:
        more, less = (left, right) if off > 0 else (right, left)
        smaller = sorted(less, key=lambda h: h["bytes"])
        sizes = [h["bytes"] for h in smaller]
        best = (abs(off), None, None)
        for a in more:
            at = bisect.bisect_left(sizes, a["bytes"] - abs(off) // 2)
            for b in [None, *smaller[max(0, at - 1) : at + 1]]:
                found = abs(abs(off) - 2 * (a["bytes"] - (b["bytes"] if b else 0)))
                if found < best[0]:
                    best = (found, a, b)
        if best[1] is None:
            return
        more.remove(best[1])
        less.append(best[1])
        if best[2]:
            less.remove(best[2])
            more.append(best[2])


def plan_splits(stats: dict[int, dict], heavies: list[dict], whole: list[int]) -> tuple[dict[int, dict], dict[int, int]]:
    """Per node: the widest dimension (as a share of ``whole``, the table's widths), bounds and target of its light units; and the side of each heavy unit."""
    nodes, side = {}, {}
    for k in {*stats, *(h["node"] for h in heavies)}:
        mine, s = [h for h in heavies if h["node"] == k], stats.get(k)
        lo = [min([*([s["lo"][i]] if s else []), *(h["d"][i] for h in mine)]) for i in range(DIMENSIONS)]
        hi = [max([*([s["hi"][i]] if s else []), *(h["d"][i] for h in mine)]) for i in range(DIMENSIONS)]
        dim = max(range(DIMENSIONS), key=lambda i: ((hi[i] - lo[i]) / max(1, whole[i]), -i))
        weight, light = sum(h["bytes"] for h in mine), s["bytes"] if s else 0
        left, most = 0, None
        mine.sort(key=lambda h: (h["d"][dim], h["unit"]))
        for n in range(len(mine) + 1):
            off = abs(2 * left - weight)
            if most is None or off < most[0]:
                most = (off, n, left)
            left += mine[n]["bytes"] if n < len(mine) else 0
        halves = mine[: most[1]], mine[most[1] :]
        even_out(*halves, light)
        side |= {h["unit"]: i for i in (0, 1) for h in halves[i]}
        target = min(light, max(0, (weight + light) // 2 - sum(h["bytes"] for h in halves[0])))
        nodes[k] = {"dim": dim, "lo": s["lo"][dim] if s else 0, "hi": s["hi"][dim] + 1 if s else 0, "bytes": weight + light, "target": target}
    return nodes, side


def leaves(made: DataFrame, levels: int, shard_bytes: float) -> DataFrame:
    """``(unit, shard)`` for the units ``made``, by ``levels`` levels of splits."""
    spark = made.sparkSession
    spans = [f(f"d{i}").alias(f"{n}{i}") for i in range(DIMENSIONS) for n, f in (("lo", F.min), ("hi", F.max))]
    is_heavy = F.col("bytes") > F.lit(shard_bytes / HEAVY)
    # at most HEAVY a shard, as their bytes add up
    heavies = [{"unit": r["unit"], "bytes": r["bytes"], "d": [r[f"d{i}"] for i in range(DIMENSIONS)], "node": 1} for r in made.filter(is_heavy).collect()]
    light = made.filter(~is_heavy).withColumn("node", F.lit(1).cast("long"))
    whole = None
    before = None
    for _ in range(levels):
        found = light.groupBy("node").agg(F.sum("bytes").alias("bytes"), *spans).collect()  # one line a node
        stats = {r["node"]: {"bytes": r["bytes"], "lo": [r[f"lo{i}"] for i in range(DIMENSIONS)], "hi": [r[f"hi{i}"] for i in range(DIMENSIONS)]} for r in found}
        if whole is None:
            all_ = [[*([stats[1]["lo"][i], stats[1]["hi"][i]] if stats else []), *(h["d"][i] for h in heavies)] for i in range(DIMENSIONS)]
            whole = [max(x, default=0) - min(x, default=0) for x in all_]
        nodes, side = plan_splits(stats, heavies, whole)
        cuts = weighted_cuts(light, nodes)
        splits = _inline(spark, ["node", "dim", "cut"], [(k, nodes[k]["dim"], c) for k, c in cuts.items()])
        place = F.element_at(F.array(*[f"d{i}" for i in range(DIMENSIONS)]), F.col("dim").cast("int") + 1)
        moved = light.join(splits, "node").withColumn("node", 2 * F.col("node") + (place >= F.col("cut")).cast("long")).drop("dim", "cut")
        light = stash(moved, "shard-level")
        if before is not None:
            release(before)
        before = light
        for h in heavies:
            h["node"] = 2 * h["node"] + side[h["unit"]]
    first = 1 << levels
    placed = light.select("unit", (F.col("node") - first).cast("int").alias("shard"))
    known = _inline(spark, ["unit", "shard"], [(h["unit"], h["node"] - first) for h in heavies])
    return placed.unionByName(known.select("unit", F.col("shard").cast("int").alias("shard")))


def levels_for(total_bytes: int, target_bytes: int) -> int:
    """Levels until the leaves reach the target."""
    return max(0, math.ceil(math.log2(max(1.0, total_bytes / target_bytes))))


def shards(docs: DataFrame, levels: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, shard (0 to 2**levels - 1) and slot.

    Give the levels, or the bytes that a shard should have at most on average.
    """
    rows = metadata(docs)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if levels is None:
        levels = levels_for(total, target_bytes) if target_bytes else LEVELS
    shard_bytes = max(1.0, total / (1 << levels))
    rows = with_unit(rows, shard_bytes)
    placed = rows.join(stash(leaves(stash(units(rows), "shard-units"), levels, shard_bytes), "shard-leaves"), "unit")
    placed = stash(placed.select("doc_id", "size", "text_crc32", "shard"), "shard-rows")
    parts = placed.count() // (SLOT_ROWS << levels) + 4
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("number", number).join(first, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    made = shards(table(spark, sf_dir, "documents"), LEVELS)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
