"""SimHash near-duplicates: 64-bit fingerprints of word shingles, pigeonhole blocks, Hamming check, components.

Two fingerprints that differ in at most ``d`` bits agree on at least ``r - d`` of ``r`` blocks,
so close pairs meet under the key of some ``r - d`` blocks.  ``r`` grows with the number of
distinct fingerprints, so that chance meetings stay rare.

Null and wordless texts have fingerprint zero and link like any other.  Copies share a
fingerprint and are one node; a key with many fingerprints is cut into blocks whose pairs are
compared in separate tasks, each of which returns only a spanning forest of its links.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, scratch, stash, with_columns

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Keys with more fingerprints than this are compared by blocks.
HOT = 64
#: Fingerprints in one block of a hot key.
BLOCK = 2048
_SLAB = 1 << 16


def fingerprint(text: bytes | None, k: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned integer; ASCII letters are lower-cased first."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= k:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    m = n - k + 1
    counts = np.zeros(64, np.int64)
    for lo in range(0, m, _SLAB):
        hi = min(lo + _SLAB, m)
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` and the fingerprint of ``text`` as a signed long column ``name``."""
    return with_columns(docs, text, f"`{name}` long", lambda texts: [[_signed(fingerprint(t)) for t in texts]])


def block_masks(n: int, bits: int = MAX_BITS) -> list[int]:
    """Masks of all choices of ``r - bits`` among ``r`` blocks; ``r`` is the least whose keys have two bits more than ``n`` needs."""
    need = math.log2(max(n, 1)) + 2
    r = next((r for r in range(bits + 1, 2 * bits + 4) if 64 * (r - bits) // r >= need), 2 * bits + 3)
    edges = [64 * i // r for i in range(r + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, r - bits)]


def spanning_forest(values: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of values that differ in at most ``bits`` bits."""
    left, right = [], []
    rest = np.unique(values.astype(np.int64).view(np.uint64))
    while len(rest):
        front, rest = [rest[-1]], rest[:-1]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), at, np.uint64))
                right.append(found)
                front.extend(found)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)


def links(fps: DataFrame, fp: str = "fp", bits: int = MAX_BITS) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints that span every component of the graph of close pairs."""
    nodes = fps.select(F.col(fp).alias("fp"))
    masks = [_signed(m) for m in block_masks(nodes.count(), bits)]
    keys = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.c", "x.k")
    met = stash(keys.groupBy("c", "k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "simhash-met")
    shared = stash(keys.join(met, ["c", "k"]), "simhash-keys")
    cold = shared.filter(F.col("m") <= HOT)
    a, b = cold.select("c", "k", F.col("fp").alias("u")), cold.select("c", "k", F.col("fp").alias("v"))
    near = a.join(b, ["c", "k"]).filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)).select("u", "v")

    hot = shared.filter(F.col("m") > HOT).withColumn("n", F.ceil(F.col("m") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    hot = hot.select("c", "k", "fp", F.col("n"), mine.alias("b")).select(
        "c", "k", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.struct(F.least(x, F.col("b")).alias("i"), F.greatest(x, F.col("b")).alias("j")))).alias("p")
    )

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = spanning_forest(pdf["fp"].to_numpy(), bits)
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    spans = hot.select("c", "k", "p.i", "p.j", "fp").groupBy("c", "k", "i", "j").applyInPandas(forest, "u long, v long")
    return near.unionByName(spans).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; root is the least node of the component.

    Alternating large and small stars: every round joins each link to the least
    neighbour, so the number of rounds grows with the logarithm of the longest chain.
    """
    edges = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        nearer = moved.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        spent, edges = edges, stash(nearer.filter("u <> v").distinct(), "links")
        release(spent)
        before, now = now, state(edges)
        if now == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def grouped(rows: DataFrame, fp: str = "fp", doc_id: str = "doc_id") -> DataFrame:
    """``(fp, root, component_id)`` of every fingerprint of ``rows``: the least fingerprint and the least id of its component."""
    nodes = stash(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "nodes")
    with scratch():  # the link tables go with their rounds
        stars = stash(components(links(nodes)), "stars", keep=True)
    roots = nodes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return roots.select("fp", "root").join(named, "root").select("fp", "root", "component_id")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (signed) and ``component_id``.

    ``component_id`` is the least id reachable over links of at most 3 bits; ids that are
    null do not count, so a group of null ids alone has a null component.
    """
    made = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp").select("doc_id", "fp")
    rows = stash(made, "fingerprints")
    return rows.join(grouped(rows), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least id (null ids last), then the least text hash.

    Groups are found and rows chosen on narrow columns; then the texts move once, to meet the
    chosen ids and hashes.  Of rows that are equal in both, one stays.
    """
    new = fresh("_near_", docs)
    key = F.xxhash64("text")
    made = with_fingerprint(docs.select("doc_id", "text", key.alias("hash")), "text", "fp").select("doc_id", "hash", "fp")
    rows = stash(made, "fingerprints").groupBy("fp", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n")
    # the best of each fingerprint first, so that a large group is one row for each of its fingerprints
    best = stash(rows.groupBy("fp").agg(F.min(order).alias("b")), "bests")
    chosen = best.join(grouped(rows), "fp").groupBy("root").agg(F.min("b").alias("b"))
    chosen = stash(chosen.select(F.col("b.doc_id").alias(f"{new}id"), F.col("b.hash").alias(f"{new}hash"), (F.col("b.n") > 1).alias(f"{new}again")), "chosen")
    met = docs.join(chosen.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(chosen[f"{new}id"]) & (F.xxhash64(docs["text"]) == chosen[f"{new}hash"]))
    again = F.col(f"{new}again")
    whole = met.filter(~again).unionByName(met.filter(again).dropDuplicates([f"{new}id", f"{new}hash"]))
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
