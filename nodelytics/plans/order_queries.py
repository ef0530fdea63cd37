"""Queries over the order tables: an order stands for a block, its lines for actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import classify_text, hex_to_decimal, relation, wei_to_gwei
from ..operators import aggregates as A
from ..operators import topk
from .event_queries import cents
from .registry import query


@query("conditional_totals_acctbal", "SELECT c_mktsegment, CAST(sum(CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS positive_sum, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_n, CAST(sum(CASE WHEN c_acctbal < 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS negative_sum, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_n FROM customer GROUP BY 1")
def conditional(t):
    made = A.conditional_totals(t("customer"), cents("c_acctbal"), {"positive": F.col("c_acctbal") > 0, "negative": F.col("c_acctbal") < 0}, ["c_mktsegment"])
    return made.withColumns({c: F.col(c).cast("double") for c in ("positive_sum", "negative_sum")})


@query("order_block_stats", "SELECT o_orderstatus, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS actions, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(q) AS DOUBLE) AS quantity FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def block_stats(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("returned"), F.sum(cents("l_quantity")).alias("q"))
    joined = t("orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("actions"), F.sum("returned").alias("returned"), F.sum("q").cast("double").alias("quantity"))


@query("nested_action_stats", "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS actions, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS operations, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS orders FROM lineitem GROUP BY 1")
def nested(t):
    kind = F.when(F.col("l_returnflag") == "N", "order").otherwise("cancel")
    blocks = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("type"), F.col("l_quantity").cast("long").alias("operations"))).alias("actions"))
    return A.block_action_stats(blocks, ["l_orderkey"], "actions")


@query("endpoint_port_rollup", "SELECT o_orderpriority, o_custkey, o_orderstatus, CAST(grouping(o_orderpriority) * 4 + grouping(o_custkey) * 2 + grouping(o_orderstatus) AS BIGINT) AS level, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_custkey), (o_orderpriority, o_orderstatus), (o_orderpriority))")
def rollup(t):
    return A.rollup_sets(t("orders"), [["o_orderpriority", "o_custkey"], ["o_orderpriority", "o_orderstatus"], ["o_orderpriority"]], [F.sum(cents("o_totalprice")).cast("double").alias("total")])


@query("weighted_discount", "SELECT l_returnflag, round(coalesce(CAST(sum(CAST(l_discount AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 0), 0), 9) AS mean_discount FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def weighted(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(A.weighted_mean(cents("l_discount").cast("double"), cents("l_extendedprice").cast("double")), 9).alias("mean_discount"))


@query("outcome_relation", "SELECT relation, count(*) AS n FROM (SELECT CASE WHEN count(l_orderkey) < 4 THEN 'fewer' WHEN count(l_orderkey) > 4 THEN 'more' ELSE 'equal' END AS relation FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) GROUP BY 1")
def outcome(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t("orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy(relation(F.coalesce("n", F.lit(0)), F.lit(4)).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("daily_representative", "WITH h AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT day, o_orderkey, count(l_orderkey) AS n_lines FROM h LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def representative(t):
    top = A.daily_representative(t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey"), "day", "o_orderkey")
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(top.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return top.select("day", "o_orderkey").join(lines, "o_orderkey", "left").select("day", "o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("topn_plus_other", "WITH s AS (SELECT o_orderpriority, o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY total DESC, o_custkey) AS r FROM s) SELECT o_orderpriority, CASE WHEN r <= 16 THEN CAST(o_custkey AS VARCHAR) ELSE 'other' END AS label, CAST(sum(total) AS DOUBLE) AS total FROM r GROUP BY 1, 2")
def topn(t):
    made = topk.topn_plus_other(t("orders").withColumn("total", cents("o_totalprice")), ["o_orderpriority"], "o_custkey", "total", 16)
    return made.withColumn("total", F.col("total").cast("double"))


@query("topk_dedup_max", "SELECT p_name, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32")
def topk_dedup(t):
    return topk.topk_dedup(t("part"), "p_name", "p_retailprice", 32)


@query("rank_with_ties", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS rank, CAST(sum(CASE WHEN p_size = m THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS BIGINT) AS ties FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part)")
def ranked(t):
    from pyspark.sql.window import Window

    rows = t("part").withColumn("m", F.max("p_size").over(Window.partitionBy("p_brand")))
    return topk.rank_with_ties(rows.select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey").select("p_brand", "p_partkey", "rank", "ties")


@query("first_k_overflow", "SELECT c_nationkey, c_custkey, CAST(greatest(0, n - 16) AS BIGINT) AS overflow FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE r <= 16")
def first_k(t):
    return topk.first_k(t("customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 16).withColumn("overflow", F.col("overflow").cast("long"))


@query("text_classify", "WITH c AS (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'none' WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') THEN 'secret' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'unknown' END AS class FROM documents), x AS (SELECT unnest(['license', 'secret', 'contact', 'unknown', 'none']) AS class) SELECT x.class, count(c.class) AS n FROM x LEFT JOIN c USING (class) GROUP BY 1")
def classify(t):
    classes = [("license", ["license"]), ("secret", ["token", "password"]), ("contact", ["@"])]
    counted = t("documents").groupBy(classify_text(F.col("text"), classes).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    census = counted.sparkSession.createDataFrame([(c,) for c in ("license", "secret", "contact", "unknown", "none")], "class string")
    return A.zero_filled(counted, census, ["class"], ["n"])


@query("hex_quantity", "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000003 AS back, CAST(o_orderkey * 1000003 AS DOUBLE) / 1000000000.0 AS gwei FROM orders")
def hex_quantity(t):
    text = F.concat(F.lit("0x"), F.hex(F.col("o_orderkey") * 1000003))
    back = hex_to_decimal(text)
    return t("orders").select("o_orderkey", back.cast("long").alias("back"), wei_to_gwei(back).alias("gwei"))


@query("union_distinct", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def union_distinct(t):
    a = t("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    return a.union(t("supplier").filter("s_acctbal > 5000").select("s_nationkey")).distinct()


@query("intersect_eligible", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def intersect(t):
    return t("customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey")).intersect(t("supplier").filter("s_acctbal > 0").select("s_nationkey"))


@query("validated_generation", "WITH bad AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_quantity) > 45), dup AS (SELECT l_orderkey FROM (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) SELECT count(*) AS rows_kept, count(DISTINCT l_orderkey) AS generations FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad) AND l_orderkey NOT IN (SELECT l_orderkey FROM dup)")
def generation(t):
    from ..operators.validation import reject_generation, unique_within

    good = unique_within(reject_generation(t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), ["l_orderkey"], F.col("l_quantity") > 45), ["l_orderkey"], ["l_suppkey"])
    return good.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows_kept"), F.count(F.lit(1)).alias("generations"))


@query("one_hot_status", "SELECT o_orderkey, s AS state, CAST(CASE WHEN o_orderstatus = s THEN 1 ELSE 0 END AS INTEGER) AS \"on\" FROM orders, (SELECT unnest(['F', 'O', 'P']) AS s)")
def one_hot(t):
    from ..operators.validation import one_hot

    return one_hot(t("orders"), "o_orderstatus", ["F", "O", "P"], ["o_orderkey"])
