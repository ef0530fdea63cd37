"""Running values with one key for all rows, in blocks; health of sources over generations; the height and process rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health, scans, windows
from ..operators.windows import micros
from . import rules
from .chain_job_queries import NODE, node
from .registry import query

#: Small, so that the driver's tables have many blocks.
ROWS = 500


def _events(t):
    return t("events").withColumn("us", micros(F.col("ts").cast("timestamp")))


@query("asof_one_key", "WITH p AS (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN p ON e.ts >= p.ts")
def asof(t):
    e = _events(t)
    made = scans.asof(e.filter("event_type = 'view'").select("event_id", "us"), e.filter("event_type = 'purchase'").select("us", F.col("event_id").alias("p_id")), [], "us", "p_id", "purchase_id", ROWS)
    return made.select("event_id", "purchase_id")


@query("last_good_one_key", """WITH g AS (SELECT event_id, ts, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS good_id, last_value(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END IGNORE NULLS) OVER w AS good_us FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN epoch_us(ts) - good_us <= 1800000000 THEN good_id END AS good_id FROM g""")
def last_good(t):
    made = scans.last_good(_events(t).select("event_id", "event_type", "us"), [], "us", ["event_id"], F.col("event_type") == "signup", ["event_id"], 1_800_000_000, ROWS)
    return made.select("event_id", F.col("last_good.event_id").alias("good_id"))


@query("advancing_one_key", """WITH b AS (SELECT *, max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WHERE value IS NOT NULL), s AS (SELECT * FROM b WHERE best IS NULL OR value > best)
SELECT event_id, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) AS gap_us FROM s""")
def advancing(t):
    return scans.advancing(_events(t).filter("value is not null").select("event_id", "value", "us"), [], "us", ["event_id"], "value", ROWS).select("event_id", "value", "gap_us")


@query("running_extremes", "SELECT event_id, max(value) OVER w AS high, min(value) OVER w AS low FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def extremes(t):
    made = scans.running(_events(t).select("event_id", "event_type", "value", "us"), ["event_type"], "us", ["event_id"], {"high": ("max", F.col("value")), "low": ("min", F.col("value"))}, rows=ROWS)
    return made.select("event_id", "high", "low")


@query("monotone_one_key", """WITH RECURSIVE o AS (SELECT event_id, event_type, user_id % 7 + event_id // 300 AS a, value + event_id / 200.0 AS b, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events WHERE value IS NOT NULL),
f AS (SELECT event_type, rn, event_id, a, b, true AS ok FROM o WHERE rn = 1 UNION ALL SELECT o.event_type, o.rn, o.event_id, CASE WHEN o.a > f.a AND o.b > f.b THEN o.a ELSE f.a END, CASE WHEN o.a > f.a AND o.b > f.b THEN o.b ELSE f.b END, o.a > f.a AND o.b > f.b FROM f JOIN o ON o.event_type = f.event_type AND o.rn = f.rn + 1)
SELECT event_id, event_type FROM f WHERE ok""")
def monotone(t):
    a, b = F.col("user_id") % 7 + F.floor(F.col("event_id") / 300), F.col("value") + F.col("event_id") / 200.0
    rows = _events(t).filter("value is not null").select("event_id", "event_type", "us", a.alias("a"), b.alias("b"))
    return scans.monotone(rows, ["event_type"], ["us", "event_id"], ["a", "b"], ROWS).select("event_id", "event_type")


#: Rare keys over snapshots of forty events: an absence of some seventy snapshots drops a key.
@query("ewma_pruned", """WITH RECURSIVE e AS (SELECT event_id // 40 AS idx, user_id * 100 + CAST(json_extract(props, '$.k') AS BIGINT) % 25 AS key, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS n FROM e),
m AS (SELECT key, idx, n, 0.3 * v AS mean FROM r WHERE n = 1 UNION ALL SELECT r.key, r.idx, r.n, 0.3 * r.v + CASE WHEN m.mean * pow(0.7, r.idx - m.idx - 1) < 1e-9 THEN 0 ELSE m.mean * pow(0.7, r.idx - m.idx) END FROM m JOIN r ON r.key = m.key AND r.n = m.n + 1)
SELECT idx, key, round(mean + 0.0000003, 4) AS ewma FROM m""")
def pruned(t):
    e = t("events").filter("value is not null").select(F.floor(F.col("event_id") / 40).alias("idx"), (F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long") % 25).alias("key"), F.col("value").cast("decimal(18,2)").alias("value"))
    rows = e.groupBy("idx", "key").agg(F.sum("value").cast("double").alias("v")).withColumn("scope", F.lit(1))
    return windows.ewma_pruned(rows, ["scope"], "key", "idx", "v", 0.3).select("idx", "key", F.round(F.col("ewma") + 3e-7, 4).alias("ewma"))  # off the decimal ties


# --- health ----------------------------------------------------------------------------------

#: An event type of a node is a source; ten days are a generation.  Sign-ups are disabled, errors cannot be read in the last one.
_THIRD = "least((day(ts) - 1) // 10, 2)"
_HEALTH = f"""WITH e AS (SELECT *, {NODE.format('user_id')} AS node_id, {_THIRD} AS g FROM events), c AS (SELECT node_id, event_type FROM e GROUP BY 1, 2),
x AS (SELECT c.node_id, c.event_type, g.g, max(CASE WHEN value >= 20 THEN ts END) AS good, max(CASE WHEN NOT value >= 20 OR value IS NULL THEN ts END) AS bad, count(CASE WHEN value < 5 THEN 1 END) AS low, count(CASE WHEN value >= 5 AND value < 20 OR value IS NULL THEN 1 END) AS odd
FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS g) g LEFT JOIN e ON e.node_id = c.node_id AND e.event_type = c.event_type AND e.g = g.g GROUP BY 1, 2, 3),
l AS (SELECT *, row_number() OVER (PARTITION BY node_id, event_type ORDER BY g DESC) AS r FROM x WHERE good IS NOT NULL OR bad IS NOT NULL)
SELECT x.node_id, x.event_type, CAST(CASE WHEN x.event_type = 'signup' THEN 0 ELSE 1 END AS INTEGER) AS enabled, CAST(CASE WHEN x.event_type = 'signup' THEN -1 ELSE 1 END AS INTEGER) AS present,
CAST(CASE WHEN x.event_type = 'signup' THEN -1 WHEN x.event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS read_ok,
CAST(CASE WHEN x.event_type = 'signup' THEN -1 ELSE coalesce(max(CASE WHEN coalesce(l.good >= l.bad, l.good IS NOT NULL) THEN 1 ELSE 0 END), -1) END AS INTEGER) AS schema_ok,
x.event_type <> 'signup' AND max(x.good) IS NOT NULL AS observed, CASE WHEN x.event_type <> 'signup' THEN max(x.good) END AS last_valid,
CAST(CASE WHEN x.event_type <> 'signup' THEN sum(x.low) ELSE 0 END AS BIGINT) AS low, CAST(CASE WHEN x.event_type <> 'signup' THEN sum(x.odd) ELSE 0 END AS BIGINT) AS odd
FROM x LEFT JOIN l ON l.node_id = x.node_id AND l.event_type = x.event_type AND l.r = 1 GROUP BY 1, 2"""


def _health(t):
    e = t("events").select(node("user_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    by, value = ["node_id", "event_type"], F.col("value")
    sources = e.select(*by).distinct()
    config = sources.withColumn("enabled", F.when(F.col("event_type") == "signup", 0).otherwise(1))
    state = None
    for g in range(3):
        part = e.filter(third == g)
        bad = part.filter((value < 20) | value.isNull()).withColumn("stage", F.when(value < 5, "low").otherwise("odd"))
        files = sources.withColumn("state", F.when((F.col("event_type") == "error") & F.lit(g == 2), "unreadable").otherwise("readable"))
        now = health.observe(config, files, part.filter(value >= 20), bad, by, F.lit(f"2024-01-{10 * g + 10} 00:00:00").cast("timestamp"))
        state = now if state is None else health.merge(state, now, by)
    return state


@query("source_health_state", _HEALTH)
def health_state(t):
    count = lambda stage: F.coalesce(F.col("errors")[stage], F.lit(0)).alias(stage)
    return _health(t).select("node_id", "event_type", "enabled", "present", "read_ok", "schema_ok", "observed", "last_valid", count("low"), count("odd"))


@query("source_failed_rule", f"SELECT node_id, 'source_failed' AS rule, count(*) AS n FROM ({_HEALTH}) WHERE enabled = 1 AND (read_ok = 0 OR schema_ok = 0) GROUP BY 1")
def failed_sources(t):
    """The state as it is at two scrapes, eleven minutes apart."""
    rows = None
    for minute in (0, 11):
        one = health.metrics(_health(t), F.col("event_type"), F.lit(f"2024-02-01 00:{minute:02d}:00").cast("timestamp"))
        rows = one if rows is None else rows.unionByName(one)
    return rules.node_alerts(rows).filter("rule = 'source_failed'").groupBy("node_id", "rule").agg(F.count(F.lit(1)).alias("n"))


# --- height and process rules ----------------------------------------------------------------

#: A sample of its node every seven seconds an event: phases of two hundred events at half, three and twenty blocks a second, and of an absent process.
_SAMPLES = f"""WITH m AS (SELECT {NODE.format('user_id')} AS node_id, event_id, 1700000000 + event_id * 7 AS s, CASE event_id // 200 % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 3.0 ELSE 20.0 END * event_id * 7 AS height, event_id // 200 % 3 = 1 AS gone FROM events),
d AS (SELECT *, regr_slope(height, s) OVER (PARTITION BY node_id ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS slope FROM m),
c AS (SELECT node_id, s, 'height_stalled' AS rule, 'critical' AS severity, 300 AS hold, coalesce(slope < 1, false) AS c FROM d WHERE node_id <> 'n2' UNION ALL SELECT node_id, s, 'height_slow', 'warning', 900, coalesce(slope >= 1 AND slope < 5, false) FROM d WHERE node_id <> 'n2' UNION ALL SELECT node_id, s, 'visor_absent', 'critical', 120, gone FROM m),
i AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY node_id, rule ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM c),
h AS (SELECT *, min(CASE WHEN c THEN s END) OVER (PARTITION BY node_id, rule, i) AS b FROM i)
SELECT node_id, to_timestamp(s)::TIMESTAMP AS ts, rule, severity FROM h WHERE c AND s - b >= hold"""


@query("height_and_process_alerts", _SAMPLES)
def height_alerts(t):
    """One node of three is not up, so its height is not judged."""
    e = t("events").select(node("user_id"), "event_id", F.timestamp_seconds(1_700_000_000 + F.col("event_id") * 7).alias("ts"), (F.floor(F.col("event_id") / 200) % 3).alias("phase"))
    speed = F.when(F.col("phase") == 0, 0.5).when(F.col("phase") == 1, 3.0).otherwise(20.0)
    values = {"up": (F.col("node_id") != "n2").cast("double"), "block_height": speed * F.col("event_id") * 7, "visor_process_up": (F.col("phase") != 1).cast("double"), "node_process_up": F.lit(1.0), "process_source_ok": F.lit(1.0)}
    rows = e.select("node_id", "ts", F.lit("all").alias("labels_key"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in values.items()])))
    return rules.node_alerts(rows)
