"""Queries over ``events``, which stands for a node's log stream: a user is a node or an endpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json
from ..functions.scalars import categorize, normalize_vocab
from ..operators import aggregates as A
from ..operators import folds, topk, validation
from ..operators import windows as W
from .registry import query

KNOWN = ["click", "view", "purchase"]
CATEGORIES = {"click": "engagement", "view": "engagement", "purchase": "commerce"}
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
CENTS = "decimal(18,2)"


def cents(c: str):
    return F.col(c).cast(CENTS)


def _histogram_sql(bounds: list[float], value: str, source: str, labels: str) -> str:
    cells = "\nUNION ALL ".join(f"SELECT {labels}, '{b:g}' AS le, CAST(sum(CASE WHEN {value} <= {b!r} THEN 1 ELSE 0 END) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE) AS total FROM s GROUP BY {labels}" for b in bounds)
    return f"WITH s AS ({source})\n{cells}\nUNION ALL SELECT {labels}, '+Inf' AS le, count(*) AS bucket, count(*) AS n, CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE) AS total FROM s GROUP BY {labels}"


@query(
    "flagship_event_histogram",
    _histogram_sql(BOUNDS, "value", "SELECT CASE WHEN event_type IN ('click','view','purchase') THEN event_type ELSE 'other' END AS event, CASE WHEN value IS NULL OR value < 0 THEN 'negative' WHEN value > 200 THEN 'too_large' ELSE 'ok' END AS verdict, value FROM events WHERE value IS NOT NULL", "event, verdict"),
)
def flagship(t):
    checked = validation.validate(t("events"), [("value", "negative", F.col("value").isNull() | (F.col("value") < 0)), ("value", "too_large", F.col("value") > 200)])
    rows = checked.select(normalize_vocab(F.col("event_type"), KNOWN).alias("event"), F.coalesce("reject.reason", F.lit("ok")).alias("verdict"), "value")
    return A.explicit_histogram(rows, "value", BOUNDS, ["event", "verdict"], F.sum(cents("value")).cast("double"))


@query("vocab_normalize_counts", "SELECT CASE WHEN event_type IN ('click','view','purchase') THEN event_type ELSE 'other' END AS event, CASE event_type WHEN 'click' THEN 'engagement' WHEN 'view' THEN 'engagement' WHEN 'purchase' THEN 'commerce' ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1, 2")
def vocab(t):
    return A.counter(t("events").select(normalize_vocab(F.col("event_type"), KNOWN).alias("event"), categorize(F.col("event_type"), CATEGORIES).alias("category")), ["event", "category"])


@query("json_extract_validate", "WITH k AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT CASE WHEN k IS NULL THEN 'decode' WHEN k < 10 THEN 'range' ELSE 'accepted' END AS stage, CASE WHEN k IS NULL THEN 'missing_k' WHEN k < 10 THEN 'below_10' WHEN k % 7 = 0 THEN 'seventh' ELSE 'ok' END AS reason, count(*) AS n FROM k GROUP BY 1, 2")
def json_validate(t):
    rows = t("events").select(json.req(json.record(F.col("props")), "$.k", "int").alias("k"))
    checked = validation.validate(rows, [("decode", "missing_k", F.col("k").isNull()), ("range", "below_10", F.col("k") < 10), ("accepted", "seventh", F.col("k") % 7 == 0)])
    good, rejects = validation.split_rejects(checked)
    accepted = good.agg(F.lit("accepted").alias("stage"), F.lit("ok").alias("reason"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    return validation.reject_counts(rejects).unionByName(accepted)


@query("explicit_histogram_value", _histogram_sql(BOUNDS, "value", "SELECT event_type, value FROM events WHERE value IS NOT NULL", "event_type"))
def histogram(t):
    return A.explicit_histogram(t("events"), "value", BOUNDS, ["event_type"], F.sum(cents("value")).cast("double"))


GAPS = A.exponential_bounds(60.0, 4.0, 8)


@query("exponential_histogram_gap", _histogram_sql(GAPS, "gap_s", "SELECT event_type, gap_s FROM (SELECT event_type, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 1000000.0 AS gap_s FROM events) WHERE gap_s IS NOT NULL", "event_type"))
def gap_histogram(t):
    gaps = W.inter_arrival(t("events"), ["user_id"], "ts", "event_id").select("event_type", (F.col("gap_ms") / 1000.0).alias("gap_s"))
    return A.explicit_histogram(gaps, "gap_s", GAPS, ["event_type"], F.sum(cents("gap_s")).cast("double"))


@query("latest_per_user", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(t):
    return A.latest_per_key(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("distinct_positive", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS n FROM events WHERE value > 50 GROUP BY 1")
def distinct_positive(t):
    return A.distinct_positive(t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], "user_id", F.col("value") - 50)


@query("sum_positive_delta", "SELECT event_type, CAST(sum(CASE WHEN d > 0 THEN CAST(d AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS total FROM (SELECT event_type, CAST(value AS DECIMAL(18,2)) - lag(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY 1")
def positive_sum(t):
    from pyspark.sql.window import Window

    v = cents("value")
    delta = v - F.lag(v).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return A.sum_positive(t("events").withColumn("d", delta), ["event_type"], F.col("d")).withColumn("total", F.col("total").cast("double"))


@query("poll_peak", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, user_id, max(value) AS peak FROM events GROUP BY 1, 2")
def peak(t):
    return A.poll_peak(t("events"), ["user_id"], "ts", "value", "1 hour").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "user_id", "peak")


@query("participation_last100", "WITH l AS (SELECT event_type, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100) SELECT l.event_type, CAST(user_id AS BIGINT) AS signer, count(*) * 100.0::DOUBLE / max(c.n) AS rate FROM l JOIN (SELECT event_type, count(*) AS n FROM l GROUP BY 1) c USING (event_type) GROUP BY 1, 2")
def participation(t):
    return A.participation_rate(t("events").withColumn("signers", F.array("user_id")), ["event_type"], ["ts", "event_id"], "signers")


@query("unique_seen_windows", "WITH m AS (SELECT max(ts) AS m FROM events), l AS (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY 1, 2) SELECT event_type, CAST(count(*) FILTER (last >= m - INTERVAL 1 DAY) AS BIGINT) AS d1, CAST(count(*) FILTER (last >= m - INTERVAL 7 DAY) AS BIGINT) AS d7, CAST(count(*) FILTER (last >= m - INTERVAL 30 DAY) AS BIGINT) AS d30 FROM l, m GROUP BY 1")
def unique_seen(t):
    events = t("events")
    as_of = events.agg(F.max("ts").alias("as_of"))  # one row
    rows = events.join(F.broadcast(as_of))
    return A.unique_seen(rows, ["event_type", "as_of"], "user_id", "ts", F.col("as_of"), {f"d{d}": d * 86_400 for d in (1, 7, 30)}).drop("as_of")


@query("inter_arrival", "SELECT event_id, user_id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 1000.0 AS gap_ms FROM events")
def inter_arrival(t):
    return W.inter_arrival(t("events"), ["user_id"], "ts", "event_id").select("event_id", "user_id", "gap_ms")


@query("advancing_interval", "SELECT event_id, CASE WHEN epoch_us(ts) > b THEN CAST(epoch_us(ts) - b AS DOUBLE) / 1000.0 END AS gap_ms FROM (SELECT event_id, ts, max(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)")
def advancing(t):
    return W.advancing_interval(t("events"), ["event_type"], ["value", "event_id"], "ts").select("event_id", "gap_ms")


@query("positive_step", "SELECT event_id, user_id, CAST(step AS DOUBLE) AS step FROM (SELECT event_id, user_id, CAST(value AS DECIMAL(18,2)) - lag(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) WHERE step > 0")
def positive_step(t):
    return W.positive_step(t("events").withColumn("v", cents("value")), ["user_id"], ["ts", "event_id"], "v").select("event_id", "user_id", F.col("step").cast("double").alias("step"))


@query("epoch_positive_delta", "SELECT event_id, CAST(greatest(0, coalesce(v - lag(v) OVER (PARTITION BY user_id, day ORDER BY ts, event_id), 0)) AS DOUBLE) AS value_delta FROM (SELECT *, CAST(value AS DECIMAL(18,2)) AS v, strftime(ts, '%Y-%m-%d') AS day FROM events)")
def epoch_delta(t):
    rows = t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("value", cents("value"))
    return W.positive_delta(rows, ["user_id"], ["day"], ["ts", "event_id"], ["value"]).select("event_id", F.col("value_delta").cast(CENTS).cast("double").alias("value_delta"))


@query("counter_increase", "WITH d AS (SELECT event_id, user_id, ts, CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END AS d FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, lag(CAST(json_extract(props, '$.k') AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) SELECT event_id, user_id, sum(d) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS increase FROM d")
def counter_increase(t):
    rows = t("events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return W.increase(rows, ["user_id"], "ts", "k", 86_400, "event_id").select("event_id", "user_id", "increase")


@query("deriv_slope", "WITH x AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0 AS x FROM events) SELECT event_id, round(regr_slope(value, x) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) * 1000, 3) AS milli_slope FROM x QUALIFY count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) > 2")
def deriv(t):
    from pyspark.sql.window import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy(W.micros("ts")).rangeBetween(-86_400_000_000, 0))
    return W.deriv(t("events").withColumn("n", n), ["user_id"], "ts", "value", 86_400).filter("n > 2").select("event_id", F.round(F.col("slope") * 1000, 3).alias("milli_slope"))


@query("hold_for", "WITH c AS (SELECT *, coalesce(value < 80, false) AS c FROM events), i AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM c) SELECT event_id, user_id, c AND epoch_us(ts) - min(CASE WHEN c THEN epoch_us(ts) END) OVER (PARTITION BY user_id, i) >= 86400000000 AS firing FROM i")
def hold_for(t):
    return W.hold_for(t("events"), ["user_id"], "ts", "event_id", F.col("value") < 80, 86_400).select("event_id", "user_id", "firing")


_DAILY_TOP = "SELECT day, user_id FROM (SELECT CAST(ts AS DATE) AS day, user_id, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY day ORDER BY v DESC, user_id) <= 5"


def _daily_top(t):
    daily = t("events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.sum(cents("value")).alias("v"))
    return topk.rank_with_ties(daily, ["day"], "v", "user_id").filter("rank <= 5").select("day", "user_id")


@query("consecutive_presence", f"WITH top AS ({_DAILY_TOP}), d AS (SELECT day, row_number() OVER (ORDER BY day) AS idx FROM (SELECT DISTINCT day FROM top)), e AS (SELECT * FROM top JOIN d USING (day)) SELECT strftime(b.day, '%Y-%m-%d') AS day, b.user_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.idx = a.idx + 1 AND b.day - a.day <= 1")
def presence(t):
    made = W.consecutive_presence(_daily_top(t).withColumn("scope", F.lit(1)), ["scope"], "user_id", "day", 1, F.unix_date("day"))
    return made.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id")


@query("membership_tenure", f"WITH top AS ({_DAILY_TOP}), d AS (SELECT day, row_number() OVER (ORDER BY day) AS idx FROM (SELECT DISTINCT day FROM top)), e AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS run FROM top JOIN d USING (day)) SELECT strftime(day, '%Y-%m-%d') AS day, user_id, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY idx) AS INTEGER) AS tenure FROM e")
def tenure(t):
    made = W.membership_tenure(_daily_top(t).withColumn("scope", F.lit(1)), ["scope"], "user_id", "day")
    return made.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", "tenure")


@query("change_count", "SELECT user_id, CAST(sum(CASE WHEN p <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def changes(t):
    return W.change_count(t("events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("last_good", "SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS good_value FROM events")
def last_good(t):
    return W.last_good(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", ["value"]).select("event_id", "good_value")


@query("sticky_topn", "WITH f AS (SELECT event_type, user_id, min((ts, event_id)) AS f FROM events GROUP BY 1, 2), r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY f, user_id) AS r FROM f) SELECT event_type, CASE WHEN r <= 5 THEN CAST(user_id AS VARCHAR) ELSE 'other' END AS label, count(*) AS n FROM events JOIN r USING (event_type, user_id) GROUP BY 1, 2")
def sticky(t):
    return A.counter(W.sticky_topn(t("events"), ["event_type"], "user_id", ["ts", "event_id"], 5), ["event_type", "label"])


@query("monotone_filter", "WITH RECURSIVE o AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), f AS (SELECT user_id, rn, event_id, k AS bk, value AS bv, true AS ok FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN o.k > f.bk AND o.value > f.bv THEN o.k ELSE f.bk END, CASE WHEN o.k > f.bk AND o.value > f.bv THEN o.value ELSE f.bv END, o.k > f.bk AND o.value > f.bv FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1) SELECT event_id, user_id, bk AS k, bv AS value FROM f WHERE ok")
def monotone(t):
    rows = t("events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return folds.monotone_filter(rows, ["user_id"], ["ts", "event_id"], ["k", "value"]).select("event_id", "user_id", "k", "value")


_DAILY = "SELECT CAST(ts AS DATE) AS day, user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY 1, 2"


@query("ewma_daily", f"WITH d AS ({_DAILY}), m AS (SELECT min(day) AS m FROM d) SELECT strftime(a.day, '%Y-%m-%d') AS day, a.user_id, round(sum(0.3 * b.v * pow(0.7, a.day - b.day)) + 0.0000003, 4) AS ewma FROM d a JOIN d b ON a.user_id = b.user_id AND b.day <= a.day GROUP BY 1, 2")
def ewma(t):
    daily = t("events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.sum(cents("value")).cast("double").alias("v"))
    first = daily.agg(F.min("day").alias("first"))  # one row
    rows = daily.join(F.broadcast(first)).withColumn("idx", F.datediff("day", "first"))
    return W.ewma(rows.withColumn("scope", F.lit(1)), ["scope"], "user_id", "idx", "v", 0.3).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", F.round(F.col("ewma") + 3e-7, 4).alias("ewma"))  # off the decimal ties


_MEANS = """WITH RECURSIVE d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY 1, 2, 3),
p AS (SELECT event_type, day, list({'k': CAST(user_id AS VARCHAR), 'v': v}) AS items, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM d GROUP BY 1, 2),
s AS (SELECT event_type, 0::BIGINT AS n, NULL::VARCHAR AS day, []::STRUCT(k VARCHAR, m DOUBLE)[] AS means, NULL::VARCHAR AS now, 0::BIGINT AS tenure, 0::BIGINT AS switches FROM p GROUP BY 1
UNION ALL SELECT event_type, n, day, means, next, CASE WHEN now IS NOT NULL AND next = now THEN tenure + 1 ELSE 1 END, switches + CASE WHEN now IS NOT NULL AND next <> now THEN 1 ELSE 0 END
FROM (SELECT *, CASE WHEN own IS NULL OR list_max(list_transform(means, lambda x: x.m)) > 1.2 * own THEN list_sort(list_filter(list_transform(means, lambda x: {'m': -x.m, 'k': x.k}), lambda x: true))[1].k ELSE now END AS next
FROM (SELECT *, list_filter(means, lambda x: x.k = now)[1].m AS own FROM (SELECT p.event_type, p.n, p.day, s.now, s.tenure, s.switches, list_concat(
list_transform(p.items, lambda i: {'k': i.k, 'm': coalesce(list_filter(s.means, lambda x: x.k = i.k)[1].m, 0.0) * 0.7 + 0.3 * i.v}),
list_transform(list_filter(s.means, lambda x: NOT list_contains(list_transform(p.items, lambda i: i.k), x.k)), lambda x: {'k': x.k, 'm': x.m * 0.7})) AS means FROM s JOIN p ON p.event_type = s.event_type AND p.n = s.n + 1))))"""


@query("dominant_hysteresis", f"{_MEANS} SELECT event_type, day, now AS dominant, round(list_filter(means, lambda x: x.k = now)[1].m / list_sum(list_transform(means, lambda x: x.m)), 9) AS share, round(coalesce(list_max(list_transform(list_filter(means, lambda x: x.k <> now), lambda x: x.m)), 0.0) / list_filter(means, lambda x: x.k = now)[1].m, 9) AS challenger, tenure, switches FROM s WHERE n > 0")
def dominant(t):
    daily = t("events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.sum(cents("value")).cast("double").alias("v"))
    made = folds.ewma_dominant(daily, ["event_type"], "day", "user_id", "v").drop("ties")
    return made.withColumns({c: F.round(c, 9) for c in ("share", "challenger")})


@query("source_health", "WITH o AS (SELECT event_type, count(*) AS records, CAST(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) AS BIGINT) AS rejects, max(epoch_us(ts)) AS last_attempt_us, max(CASE WHEN value >= 5 THEN epoch_us(ts) END) AS last_valid_us FROM events GROUP BY 1) SELECT event_type, records, rejects, CAST(CASE WHEN last_valid_us = last_attempt_us THEN 1 ELSE 0 END AS INTEGER) AS schema_ok, CAST(last_attempt_us - last_valid_us AS DOUBLE) / 1000000.0 AS valid_age_s FROM o")
def health(t):
    from .jobs import source_health

    rows = validation.validate(t("events"), [("value", "small", F.col("value") < 5)])
    return source_health(rows, ["event_type"], "ts").select("event_type", "records", "rejects", "schema_ok", "valid_age_s")


@query("alert_rules", "WITH h AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS big, count(*) AS n FROM events GROUP BY 1, 2) SELECT 'many_errors' AS rule, day, event_type AS series FROM h WHERE event_type = 'error' AND n > 50 UNION ALL SELECT 'large_values' AS rule, day, event_type AS series FROM h WHERE big > 0 UNION ALL SELECT 'quiet' AS rule, day, event_type AS series FROM h WHERE n < 30")
def alerts(t):
    from .rules import Rule, evaluate

    daily = t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("series")).agg(F.sum((F.col("value") > 100).cast("long")).alias("big"), F.count(F.lit(1)).alias("n"))
    rules = [Rule("many_errors", (F.col("series") == "error") & (F.col("n") > 50)), Rule("large_values", F.col("big") > 0), Rule("quiet", F.col("n") < 30)]
    return evaluate(daily, rules).select("rule", "day", "series")


@query("lifecycle_funnel", "WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS u, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), n AS (SELECT user_id, rn, s, u, CASE WHEN s = 0 THEN 0 ELSE NULL END AS at, CASE WHEN s = 0 THEN u END AS began, false AS done, CAST(NULL AS BIGINT) AS took FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, o.s, o.u, CASE WHEN o.s = 0 THEN 0 WHEN f.at IS NULL OR o.u - f.began > 86400000000 THEN NULL WHEN o.s = f.at + 1 THEN CASE WHEN o.s = 2 THEN NULL ELSE o.s END ELSE f.at END, CASE WHEN o.s = 0 THEN o.u WHEN f.at IS NULL OR o.u - f.began > 86400000000 THEN NULL WHEN o.s = f.at + 1 AND o.s = 2 THEN NULL ELSE f.began END, coalesce(f.at = 1 AND o.s = 2 AND o.u - f.began <= 86400000000, false), CASE WHEN f.at = 1 AND o.s = 2 AND o.u - f.began <= 86400000000 THEN o.u - f.began END FROM n f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1) SELECT user_id, count(*) AS chains, CAST(max(took) AS DOUBLE) / 1000000.0 AS longest_s FROM n WHERE done GROUP BY 1")
def funnel(t):
    rows = t("events").select("user_id", "event_type", "event_id", W.micros("ts").alias("us"))
    made = folds.lifecycle(rows, ["user_id"], ["us", "event_id"], "event_type", "us", ["view", "click", "purchase"], 86_400)
    return made.filter("completed").groupBy("user_id").agg(F.count(F.lit(1)).alias("chains"), F.max("duration_s").alias("longest_s"))


#: One step an event: the members that are not too old; added, moved up or kept; and the least recent one out beyond 20.
TTL_SQL = """WITH RECURSIVE e AS (SELECT event_type, user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT event_type, 0::BIGINT AS n, 0::BIGINT AS us, NULL::BIGINT AS user_id, []::STRUCT(t BIGINT, m BIGINT)[] AS seen, false AS added, 0::BIGINT AS expired, 0::BIGINT AS dropped FROM e GROUP BY 1
UNION ALL SELECT event_type, n, us, user_id, CASE WHEN len(kept) > 20 THEN list_sort(kept)[2:] ELSE kept END, NOT known, expired, CASE WHEN len(kept) > 20 THEN 1 ELSE 0 END
FROM (SELECT event_type, n, us, user_id, len(seen) - len(alive) AS expired, len(list_filter(alive, lambda x: x.m = user_id)) > 0 AS known, list_append(list_filter(alive, lambda x: x.m <> user_id), {'t': us, 'm': user_id}) AS kept
FROM (SELECT e.event_type, e.n, e.us, e.user_id, s.seen, list_filter(s.seen, lambda x: e.us - x.t <= 43200000000) AS alive FROM s JOIN e ON e.event_type = s.event_type AND e.n = s.n + 1)))"""


@query("ttl_set_fold", f"{TTL_SQL} SELECT event_type, CAST(sum(CASE WHEN added THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(expired) AS BIGINT) AS expired, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(max(len(seen)) AS BIGINT) AS largest FROM s WHERE n > 0 GROUP BY 1")
def ttl(t):
    rows = t("events").select("event_type", "user_id", "event_id", W.micros("ts").alias("us"))
    return folds.ttl_set(rows, ["event_type"], ["us", "event_id"], "user_id", "us", 43_200, 20).groupBy("event_type").agg(F.sum(F.col("added").cast("long")).alias("added"), F.sum("expired").alias("expired"), F.sum("dropped").alias("dropped"), F.max("size").alias("largest"))
