"""Streaming queries over ``events``: run over what is there, each to its end, and read back from the shared folder.

The stream runs in a session of its own, since stateful operators need the RocksDB state store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains
from ..sources.scratch import shared_dir
from ..streaming import keyed, state
from . import event_queries, join_queries  # noqa: F401
from .registry import QUERIES, SQL, query

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_query(name: str, sql: str | None = None, sink: Callable | None = None, schema: str | None = None, at: str = "rows"):
    """Register ``function(events)``, which makes a streaming DataFrame of the streaming table ``events``.

    With ``sink(home)``, each batch goes through the function that it returns, which writes rows of ``schema`` to ``home`` at ``at``.
    """

    def add(function: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            own = spark.newSession()
            own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
            own.conf.set("spark.sql.session.timeZone", "UTC")
            path = f"{sf_dir}/events.parquet"
            events = own.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]").withColumn("ts", F.col("ts").cast("timestamp"))
            made = function(events)
            home = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            writer = made.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{home}/state")
            writer = writer.foreachBatch(sink(home)) if sink else writer.format("parquet").option("path", f"{home}/rows")
            writer.start().awaitTermination()
            return spark.read.schema(schema or made.schema).parquet(f"{home}/{at}")

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return function

    return add


@stream_query("dedupe_stream", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe(events: DataFrame) -> DataFrame:
    return state.dedupe(events, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")


@stream_query("request_reply_stream", SQL["request_reply_join"])
def request_reply(events: DataFrame) -> DataFrame:
    a = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("req_id"), F.col("ts").alias("req_ts"))
    b = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("rep_id"), F.col("ts").alias("rep_ts"))
    made = state.correlate(a, b, ["user_id"], "req_ts", "rep_ts", "1 hour")
    return made.select("req_id", "rep_id", ((F.unix_micros("rep_ts") - F.unix_micros("req_ts")) / 1e6).alias("delay_s"))


@stream_query("sticky_names_stream", SQL["sticky_topn"].replace("SELECT event_type, CASE WHEN r <= 5 THEN CAST(user_id AS VARCHAR) ELSE 'other' END AS label, count(*) AS n FROM", "SELECT event_type AS key, event_id AS seq, CASE WHEN r <= 5 THEN CAST(user_id AS VARCHAR) ELSE 'other' END AS label FROM").rsplit(" GROUP BY 1, 2", 1)[0],
    sink=lambda home: state.sticky_batches("event_type", "user_id", "us", "event_id", 5, home), schema="key string, seq long, label string", at="rows/*")
def sticky(events: DataFrame) -> DataFrame:
    return events.withColumn("us", F.unix_micros("ts"))


@stream_query("ttl_set_stream", f"{event_queries.TTL_SQL} SELECT event_type AS key, us, added, expired, dropped, CAST(len(seen) AS BIGINT) AS size FROM s WHERE n > 0", sink=lambda home: state.ttl_batches("event_type", "user_id", "us", "event_id", 43_200, 20, home), schema=state.OUT, at="made/*/state=false")
def ttl(events: DataFrame) -> DataFrame:
    return events.withColumn("us", F.unix_micros("ts"))


#: The last 20 different users of each event type by arrival, one step an event.
RECENT_SQL = """WITH RECURSIVE e AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS seen, false AS fresh FROM e GROUP BY 1
UNION ALL SELECT e.event_type, e.n, e.event_id, CASE WHEN list_contains(s.seen, e.user_id) THEN s.seen WHEN len(s.seen) = 20 THEN list_append(s.seen[2:], e.user_id) ELSE list_append(s.seen, e.user_id) END, NOT list_contains(s.seen, e.user_id)
FROM s JOIN e ON e.event_type = s.event_type AND e.n = s.n + 1) SELECT event_type AS key, event_id AS seq, fresh FROM s WHERE n > 0"""


@stream_query("recent_keys_stream", RECENT_SQL)
def recent(events: DataFrame) -> DataFrame:
    return keyed.recent(events.withColumn("us", F.unix_micros("ts")), "event_type", "user_id", "us", "event_id", 20).select("key", "seq", "fresh")


@query("recent_keys", RECENT_SQL)
def recent_batch(t):
    return chains.recent(t("events"), ["event_type"], ["ts", "event_id"], "user_id", 20).select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), "fresh")


#: Each user's chain of view, click and purchase; a day without a step ends it, and it completes once a day.
CHAIN_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS u, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS u, NULL::INTEGER AS place, NULL::BIGINT AS began, NULL::BIGINT AS touched, NULL::BIGINT AS done, '' AS verdict, NULL::BIGINT AS took, NULL::BIGINT AS gone FROM e GROUP BY 1
UNION ALL SELECT user_id, n, event_id, u, CASE WHEN verdict IN ('opened', 'moved') THEN s WHEN verdict = 'completed' THEN NULL ELSE place END, CASE WHEN verdict = 'opened' THEN u ELSE began END, CASE WHEN verdict IN ('opened', 'moved') THEN u ELSE touched END, CASE WHEN verdict = 'completed' THEN u ELSE done END, verdict, CASE WHEN verdict = 'completed' THEN u - began END, gone
FROM (SELECT *, CASE WHEN s < 0 THEN 'unknown' WHEN s = 0 THEN CASE WHEN place IS NULL THEN 'opened' ELSE 'unjoinable' END WHEN place IS NULL OR place <> s - 1 THEN 'unjoinable' WHEN s = 1 THEN 'moved' WHEN done IS NOT NULL AND u - done <= 86400000000 THEN 'unjoinable' ELSE 'completed' END AS verdict
FROM (SELECT e.user_id, e.n, e.event_id, e.u, e.s, CASE WHEN e.u - f.touched <= 86400000000 THEN f.place END AS place, f.began, f.touched, f.done, CASE WHEN f.place IS NOT NULL AND e.u - f.touched > 86400000000 THEN f.touched END AS gone FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))"""
_CHAIN_ROWS = "SELECT CAST(user_id % 3 AS VARCHAR) AS key, CAST(user_id AS VARCHAR) AS chain, u AS us, event_id AS seq, verdict, CAST(took AS DOUBLE) / 1000000.0 AS duration_s FROM f WHERE n > 0"
_CHAIN_ENDS = """, l AS (SELECT * FROM f WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1), w AS (SELECT user_id % 3 AS k, max(epoch_us(ts)) AS last, (SELECT max(epoch_us(ts)) - 3600000000 FROM events) AS mark FROM events GROUP BY 1)"""
_CHAIN_GONE = """ UNION ALL SELECT CAST(user_id % 3 AS VARCHAR), CAST(user_id AS VARCHAR), gone, NULL, 'expired', NULL FROM f WHERE gone IS NOT NULL
UNION ALL SELECT CAST(user_id % 3 AS VARCHAR), CAST(user_id AS VARCHAR), touched, NULL, 'expired', NULL FROM l JOIN w ON w.k = user_id % 3 WHERE place IS NOT NULL AND greatest(last, mark) - touched > 86400000000"""


def _chain_columns(events: DataFrame) -> DataFrame:
    user = F.col("user_id").cast("string")
    return events.select((F.col("user_id") % 3).alias("node"), "event_type", user.alias("chain"), F.lit(None).cast("string").alias("alias"), F.lit("t").alias("token"), "ts", "event_id")


@stream_query("chains_stream", CHAIN_SQL + _CHAIN_ENDS + _CHAIN_ROWS + _CHAIN_GONE)
def chain_stream(events: DataFrame) -> DataFrame:
    return keyed.chains(_chain_columns(events), "node", "event_type", "chain", "alias", "token", "ts", "event_id", ["view", "click", "purchase"], 86_400, "1 hour", capacity=1_000_000)


@query("chains", CHAIN_SQL + " " + _CHAIN_ROWS)
def chain_batch(t):
    rows = _chain_columns(t("events")).withColumns({"node": F.col("node").cast("string"), "us": F.unix_micros(F.col("ts").cast("timestamp"))})
    made = chains.chains(rows, ["node"], "event_type", "chain", "alias", "token", "us", "event_id", ["view", "click", "purchase"], 86_400, 1_000_000)
    return made.filter("verdict <> 'expired'").withColumnRenamed("node", "key")


#: Views are requests and purchases replies; the latest view of a user and k counts for a day and is known for two.
_OUTCOME_SQL = """WITH x AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id, event_type, epoch_us(ts) AS u FROM events WHERE event_type IN ('view', 'purchase')),
q AS (SELECT *, coalesce(sum(CASE WHEN u - b > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY u, event_id), 0) AS life FROM (SELECT *, lag(u) OVER (PARTITION BY user_id, k ORDER BY u, event_id) AS b, lead(u) OVER (PARTITION BY user_id, k ORDER BY u, event_id) AS z FROM x WHERE event_type = 'view')),
p AS (SELECT r.user_id, r.k, r.event_id, r.u, q.u AS t, q.life, coalesce(r.u - q.u <= 86400000000, false) AS good FROM (SELECT * FROM x WHERE event_type = 'purchase') r ASOF LEFT JOIN q ON r.user_id = q.user_id AND r.k = q.k AND r.u >= q.u),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, k, life, good ORDER BY u, event_id) AS n, EXISTS (SELECT 1 FROM q WHERE q.user_id = p.user_id AND q.u <= p.u AND p.u - q.u <= 172800000000) AS known FROM p),
w AS (SELECT user_id, max(u) AS last FROM x GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS loose, user_id || '|' || k AS exact, u AS us, event_id AS seq, CASE WHEN good AND n = 1 THEN 'matched' WHEN known THEN 'mismatch' ELSE 'orphan' END AS outcome FROM o
UNION ALL SELECT CAST(user_id AS VARCHAR), user_id || '|' || k, u, NULL, 'expired' FROM q JOIN w USING (user_id) WHERE coalesce(z - u > 86400000000, true) AND greatest(last, (SELECT max(u) - 3600000000 FROM x)) - u > 86400000000
AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = q.user_id AND p.k = q.k AND p.u >= q.u AND p.u - q.u <= 86400000000)"""


@stream_query("reply_outcomes_stream", _OUTCOME_SQL)
def reply_outcomes(events: DataFrame) -> DataFrame:
    rows = events.filter("event_type in ('view', 'purchase')").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.lit("s").alias("source"), (F.col("event_type") == "purchase").alias("reply"), "ts", "event_id")
    return keyed.outcomes(rows, ["user_id"], ["user_id", "k"], "source", "reply", "ts", "event_id", 86_400, "1 hour")


@stream_query("monotone_stream", SQL["monotone_filter"].rsplit(" SELECT event_id", 1)[0] + " SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CASE WHEN ok THEN 'accepted' ELSE 'late' END AS verdict FROM f")
def monotone(events: DataFrame) -> DataFrame:
    rows = events.withColumns({"k": F.get_json_object("props", "$.k").cast("double"), "n": F.struct("ts", "event_id")})
    return state.monotone(rows, "user_id", "event_id", ["k", "value"])
