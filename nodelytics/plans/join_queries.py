"""Join queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import fresh
from ..operators import aggregates as A
from ..operators import joins as J
from .registry import query


@query("identity_resolution", "SELECT o_orderkey, coalesce(c.c_name, s.s_name, 'unknown') AS name FROM (SELECT o_orderkey, o_custkey * 2 AS k FROM orders) o LEFT JOIN customer c ON c.c_custkey = o.k AND c.c_custkey % 3 = 0 LEFT JOIN supplier s ON s.s_suppkey = o.k")
def identity(t):
    signers = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    validators = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return J.resolve_identity(t("orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("k")), "k", signers, validators).select("o_orderkey", "name")


@query("truncated_unique_join", "WITH r AS (SELECT left(c_name, 6) || '..' || right(c_name, 2) || CAST(c_nationkey AS VARCHAR) || c_mktsegment AS t, c_name FROM customer), u AS (SELECT t, min(c_name) AS c_name FROM r GROUP BY 1 HAVING count(DISTINCT c_name) = 1) SELECT c_custkey, u.c_name AS resolved FROM (SELECT c_custkey, left(c_name, 6) || '..' || right(c_name, 2) || CAST(c_nationkey AS VARCHAR) || c_mktsegment AS t FROM customer) LEFT JOIN u USING (t)")
def truncated(t):
    cut = F.concat(F.substring("c_name", 1, 6), F.lit(".."), F.substring("c_name", -2, 2), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"))
    rows = t("customer").select("c_custkey", cut.alias("t"))
    return J.expand_truncated(rows, "t", t("customer"), "c_name", cut).select("c_custkey", F.col("full").alias("resolved"))


def _sides(t):
    events = t("events").select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    requests = events.filter("event_type = 'view'").select("user_id", "k", F.col("event_id").alias("req_id"), F.col("ts").alias("req_ts"))
    replies = events.filter("event_type = 'purchase'").select("user_id", "k", F.col("event_id").alias("rep_id"), F.col("ts").alias("rep_ts"))
    return requests, replies


_SIDES = "WITH q AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS req_id, ts AS req_ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS rep_id, ts AS rep_ts FROM events WHERE event_type = 'purchase')"


@query("request_reply_join", f"{_SIDES} SELECT req_id, rep_id, CAST(epoch_us(rep_ts) - epoch_us(req_ts) AS DOUBLE) / 1000000.0 AS delay_s FROM q JOIN p USING (user_id) WHERE rep_ts >= req_ts AND epoch_us(rep_ts) - epoch_us(req_ts) <= 3600000000")
def request_reply(t):
    requests, replies = _sides(t)
    return J.correlate(requests.drop("k"), replies.drop("k"), ["user_id"], "req_ts", "rep_ts", 3600).select("req_id", "rep_id", "delay_s")


@query("request_reply_outcomes", f"{_SIDES}, l AS (SELECT user_id, k, max(req_ts) AS t FROM q GROUP BY 1, 2), n AS (SELECT DISTINCT user_id FROM q), j AS (SELECT p.*, l.t, n.user_id IS NOT NULL AS known, coalesce(rep_ts >= t AND epoch_us(rep_ts) - epoch_us(t) <= 604800000000, false) AS good FROM p LEFT JOIN l USING (user_id, k) LEFT JOIN n USING (user_id)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k, good ORDER BY rep_ts, rep_id) AS rn FROM j) SELECT rep_id, CASE WHEN good AND rn = 1 THEN 'matched' WHEN good OR t IS NOT NULL OR known THEN 'mismatch' ELSE 'orphan' END AS outcome FROM r")
def outcomes(t):
    requests, replies = _sides(t)
    made = J.reply_outcomes(requests, replies.withColumn("src", F.lit(1)), ["user_id", "k"], ["user_id"], "src", "req_ts", "rep_ts", "rep_id", 604_800)
    return made.select("rep_id", "outcome")


@query("request_expired", f"{_SIDES} SELECT req_id FROM q WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(req_ts) > 3600000000 AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = q.user_id AND rep_ts >= req_ts AND epoch_us(rep_ts) - epoch_us(req_ts) <= 3600000000)")
def expired(t):
    requests, replies = _sides(t)
    end = t("events").agg(F.max("ts").alias("end"))  # one row
    return J.unanswered(requests.join(F.broadcast(end)), replies, ["user_id"], "req_ts", "rep_ts", 3600, F.col("end")).select("req_id")


@query("band_pair", "WITH e AS (SELECT event_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase') SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM e JOIN p ON abs(epoch_us(e.ts) - epoch_us(p.ts)) <= 300000000 QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY greatest(e.ts, p.ts) DESC, abs(epoch_us(e.ts) - epoch_us(p.ts)), p.event_id) = 1")
def band(t):
    events = t("events").withColumn("g", F.lit(1))
    errors = events.filter("event_type = 'error'").select("g", F.col("event_id").alias("error_id"), F.col("ts").alias("e_ts"))
    purchases = events.filter("event_type = 'purchase'").select("g", F.col("event_id").alias("purchase_id"), F.col("ts").alias("p_ts"))
    return J.latest_pair(errors, purchases, ["g"], "e_ts", "p_ts", 300, F.col("purchase_id")).select("error_id", "purchase_id")


@query("generation_match", "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' AND abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 2592000000000")
def generations(t):
    orders = t("orders")
    a = orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("a_key"), F.col("o_orderdate").alias("a_ts"))
    b = orders.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("b_key"), F.col("o_orderdate").alias("b_ts"))
    return J.match_generations(a, b, ["o_custkey"], "a_ts", "b_ts", 2_592_000).select("a_key", "b_key")


@query("count_semi", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def semi(t):
    eligible = t("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return J.count_semi(t("orders"), eligible, ["o_custkey"], ["o_orderpriority"])


@query("withdrawn_anti", "SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-10' AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20')")
def withdrawn(t):
    events = t("events")
    old = events.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).select("user_id", "event_type").distinct()
    return J.withdrawn(old, events.filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")), ["user_id", "event_type"])


@query("asof_lag", "WITH p AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof(t):
    events = t("events")
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    purchases = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("p_id"))
    return J.asof(views, purchases, ["user_id"], "ts", "ts", "p_id", "purchase_id").select("event_id", "purchase_id")


@query("fresh_targets", "SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey BETWEEN 1 AND 10 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def targets(t):
    as_of = F.lit("2024-01-01").cast("timestamp")
    profiles = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), (as_of - F.make_dt_interval(mins=F.col("n_nationkey") - 1) + F.make_dt_interval(secs=F.when(F.col("n_nationkey") == 0, 30).otherwise(0))).alias("seen"))
    return J.select_targets(t("supplier"), profiles, "s_nationkey", fresh(F.col("seen"), as_of, 540), [F.desc("s_acctbal"), F.col("s_suppkey")], 10).select("s_suppkey", "s_name")


_ALIAS = "SELECT c_nationkey AS g, CASE WHEN c_custkey % 2 = 0 THEN '0x' || lpad(CAST(c_custkey % 90 AS VARCHAR), 40, '0') ELSE '0x0000..' || lpad(CAST(c_custkey % 90 AS VARCHAR), 4, '0') END AS a FROM customer"


@query("alias_conflict", f"WITH r AS ({_ALIAS}), d AS (SELECT g, a, count(*) AS n FROM r GROUP BY 1, 2) SELECT x.g, x.a AS first, y.a AS second FROM d x JOIN d y ON x.g = y.g AND right(x.a, 4) = right(y.a, 4) AND x.a < y.a AND (contains(x.a, '..') OR contains(y.a, '..')) AND (starts_with(split_part(x.a, '..', 1), split_part(y.a, '..', 1)) OR starts_with(split_part(y.a, '..', 1), split_part(x.a, '..', 1))) UNION ALL SELECT g, a, a FROM d WHERE n > 1")
def alias(t):
    short = F.lpad((F.col("c_custkey") % 90).cast("string"), 40, "0")
    a = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("0x"), short)).otherwise(F.concat(F.lit("0x0000.."), F.substring(short, -4, 4)))
    return J.alias_conflicts(t("customer").select(F.col("c_nationkey").alias("g"), a.alias("a0")), ["g"], "a0")


@query("source_fallback", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def fallback(t):
    primary = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return J.coalesce_sources(primary, t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"])


@query("series_with_partner", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) GROUP BY 1")
def partner(t):
    events = t("events")
    return A.counter(J.and_on(events.filter("event_type = 'view'"), events.filter("event_type = 'error' and value > 100"), ["user_id"]), ["user_id"])
