"""Domain jobs over a node's network streams, pending transactions, latency summaries and file states."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import json, vocab
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import folds, joins, topk, validation
from ..operators import windows as W
from ..operators.windows import micros
from .jobs import Tables, _envelope_checks, _int, _items, _num, _text, checked, enveloped, once, records

# --- remote calls and connections ------------------------------------------------------------


def consensus_rpc(lines: DataFrame) -> Tables:
    """Five ordered events of a served request, joined by session and digests of request and answer within the time to live."""
    p = F.col("p")
    rows = once(enveloped(lines), {"tag": _text(p, "$[0]")})
    session = _text(p, "$[1]")
    stages = {"Incoming tcp stream": (session, None, None), "Received rpc request": (session, "$[2]", None), "Rpc task inbound": (None, "$[1]", None), "Rpc task response": (None, "$[1]", "$[2]"), "Outbound response": (session, "$[2]", "$[3]")}
    part = lambda i: _pick(F.col("tag"), {t: v[i] for t, v in stages.items()}, p)
    rows = once(rows, {"session": _pick(F.col("tag"), {t: v[0] for t, v in stages.items()}, p), "request": part(1), "response": part(2)})
    good, rejects = checked(rows, [*_envelope_checks(), ("event", "no_tag", F.col("tag").isNull())])
    e = good.select("node_id", "ts", "tag", "session", "request", "response")
    known = list(stages)
    events = A.counter(e.select("node_id", S.normalize_vocab(F.col("tag"), known, "unknown_tag").alias("event")), ["node_id", "event"])
    ttl = vocab.RPC_TTL_S * 1_000_000
    # one shuffle by request for four stages; a later time of a stage leaves no fewer before it, so the latest of each is the best
    stage = F.array_position(F.array(*[F.lit(t) for t in known]), F.col("tag")).cast("int")
    told = e.select("node_id", stage.alias("stage"), "session", *[F.unhex(c).alias(c) for c in ("request", "response")], micros("ts").alias("at"))
    has = {1: ["session"], 2: ["session", "request"], 3: ["request"], 4: ["request", "response"], 5: ["session", "request", "response"]}
    whole = lambda i: functools.reduce(lambda x, c: x & F.col(c).isNotNull(), has[i], F.col("stage") == i)
    met = told.filter(whole(2) | whole(3) | whole(4) | whole(5)).withColumn("end", F.col("at")).repartition("node_id", "request")
    for i, keys in ((4, ["request", "response"]), (3, ["request"]), (2, ["session", "request"])):
        met = _latest_before(met, i, ["node_id", *keys])
    opened = told.filter(whole(1)).withColumn("end", F.col("at"))
    met = _latest_before(met.unionByName(opened), 1, ["node_id", "session"]).filter(F.col("end") - F.col("at") <= ttl)
    # a repeated completion counts once
    served = met.groupBy("node_id", "session", "response").agg(F.min(F.col("end") - F.col("at")).alias("us")).withColumn("response", F.lower(F.hex("response")))
    return {"rpc_event": events, "rpc_served": served.withColumn("duration_s", F.col("us") / 1e6).drop("us"), "rejects": rejects}


def _latest_before(rows: DataFrame, stage: int, by: Sequence[str]) -> DataFrame:
    """``rows`` without that stage; answers (stage 5) move to its latest time up to theirs, and go if there is none."""
    w = Window.partitionBy(*by).orderBy("at", "stage").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("stage") == stage, F.col("at")), ignorenulls=True).over(w)
    made = rows.withColumn("_at", latest).filter((F.col("stage") != stage) & ((F.col("stage") < 5) | F.col("_at").isNotNull()))
    return made.withColumn("at", F.when(F.col("stage") == 5, F.col("_at")).otherwise(F.col("at"))).drop("_at")


def _pick(tag: Column, paths: Mapping[str, object], p: Column) -> Column:
    made = None
    for t, path in paths.items():
        value = path if isinstance(path, Column) else json.digest(F.try_variant_get(p, path, "variant")) if path else F.lit(None).cast("string")
        made = F.when(tag == t, value) if made is None else made.when(tag == t, value)
    return made


def validator_connections(lines: DataFrame, subsystems: Sequence[str]) -> Tables:
    p = F.col("p")
    rows = once(enveloped(lines), {"tag": _text(p, "$[0]"), "subsystem": _text(p, "$[2]")})
    good, rejects = checked(rows, [*_envelope_checks(), ("event", "no_tag", F.col("tag").isNull())])
    named = good.select("node_id", S.normalize_vocab(F.col("tag"), ["handle_stream_connection"]).alias("event"), S.normalize_vocab(F.col("subsystem"), subsystems).alias("subsystem"))
    return {"validator_conn_event": A.counter(named, ["node_id", "event", "subsystem"]), "rejects": rejects}


def gossip_children(lines: DataFrame, cap: int = 16) -> Tables:
    """The newest child-peer snapshot per node, its summary, the first peers by address, and tenures."""
    p = F.col("p")
    rows = once(enveloped(lines).filter(_text(p, "$[0]") == "child_peers status"), {"pairs": _items(p, "$[1]")})
    ip = lambda x: S.canonical_ipv4(F.coalesce(_text(x, "$[0].Ip"), _text(x, "$[0]")))
    ips = F.transform("pairs", ip)
    good, rejects = checked(rows, [*_envelope_checks(), ("peers", "no_list", F.col("pairs").isNull()), ("peers", "bad_address", F.exists(ips, lambda x: x.isNull())), ("peers", "duplicate", F.size(F.array_distinct(ips)) != F.size("pairs"))])
    each = good.select("node_id", "ts", F.explode("pairs").alias("x")).select("node_id", "ts", ip(F.col("x")).alias("ip"), json.req(F.col("x"), "$[1].verified", "bool").alias("verified"), _int(F.col("x"), "$[1].connection_count").alias("connections"))
    newest = each.groupBy("node_id").agg(F.max("ts").alias("ts"))
    now = each.join(newest, ["node_id", "ts"], "left_semi")
    tenure = W.membership_tenure(each, ["node_id"], "ip", "ts", 90_000_000).join(newest, ["node_id", "ts"], "left_semi")
    return {"child_peer": topk.first_k(now, ["node_id"], "ip", cap), "child_summary": A.child_summary(now, ["node_id"], "verified", "connections", cap), "child_tenure": tenure, "rejects": rejects}


def gossip_events(lines: DataFrame) -> Tables:
    """Connection events by closed tag; a known tag without an address is rejected, an unknown one counts as other."""
    p = F.col("p")
    rows = once(enveloped(lines), {"e": json.tagged(p), "ip": S.canonical_ip(F.coalesce(_text(p, "$[1].Ip"), _text(p, "$[1]")))})
    tag = F.col("e.tag")
    shapes = {t: F.col("e.arity") >= 2 for t in vocab.GOSSIP_TAGS}
    failed = validation.tagged_failure(tag, shapes)
    good, rejects = checked(rows, [*_envelope_checks(), ("event", "no_tag", tag.isNull()), ("payload", "bad_shape", failed.isNotNull())])
    return {"gossip_event": A.counter(good.select("node_id", S.categorize(tag, vocab.GOSSIP_TAGS).alias("event")), ["node_id", "event"]), "rejects": rejects}


# --- traffic ---------------------------------------------------------------------------------


def tcp_traffic(lines: DataFrame, ports: Sequence[int]) -> Tables:
    """Snapshots ``[[["In"|"Out", ip, port], value]...]``: endpoints summed over ports, the greatest with ``other``, ports, directions."""
    p = F.col("p")
    rows = once(enveloped(lines), {"items": _items(p, "$")})
    side = lambda x: _text(x, "$[0][0]")
    bad = lambda x: ~F.coalesce(side(x).isin("In", "Out"), F.lit(False)) | _text(x, "$[0][1]").isNull() | _int(x, "$[0][2]").isNull() | ~S.finite_nonneg(_num(x, "$[1]"))
    good, rejects = checked(rows, [*_envelope_checks(), ("rows", "no_list", F.col("items").isNull()), ("rows", "bad_row", validation.reject_if_any(F.col("items"), bad))])
    # only a record of a later time is a new snapshot
    good = good.dropDuplicates(["node_id", "ts"])
    x = F.col("x")
    each = good.select("node_id", "ts", F.explode("items").alias("x")).select("node_id", "ts", F.lower(side(x)).alias("direction"), S.canonical_ip(_text(x, "$[0][1]")).alias("ip"), S.port_label(_int(x, "$[0][2]"), ports).alias("port"), _num(x, "$[1]").alias("value"))
    endpoints = each.groupBy("node_id", "ts", "direction", "ip").agg(A.safe_sum(F.col("value")).alias("value"))
    totals = A.rollup_sets(each, [["node_id", "ts", "direction", "port"], ["node_id", "ts", "direction"]], [A.safe_sum(F.col("value")).alias("total")])
    return {
        "endpoints": endpoints, "traffic_endpoint": topk.topn_plus_other(endpoints, ["node_id", "ts", "direction"], "ip", "value", vocab.TRAFFIC_TOP), "traffic_port": totals,
        "active": A.distinct_positive(endpoints, ["node_id", "ts"], "ip", F.col("value")), "rejects": rejects,
    }


def endpoint_set(endpoints: DataFrame, as_of: Column) -> Tables:
    """Endpoints that were among the greatest in two consecutive snapshots, kept in a bounded set; counts seen lately."""
    ranked = topk.rank_with_ties(endpoints.filter("value > 0"), ["node_id", "ts", "direction"], "value", "ip").filter(F.col("rank") <= vocab.TRAFFIC_TOP)
    admitted = W.consecutive_presence(ranked, ["node_id"], "ip", "ts", vocab.ADMISSION_GAP_S * 1_000_000)
    rows = admitted.select("node_id", "ip", "ts", micros("ts").alias("us"))
    kept = folds.ttl_set(rows, ["node_id"], ["us", "ip"], "ip", "us", vocab.SET_TTL_S, vocab.SET_CAPACITY)
    return {"endpoint_set": kept, "seen": A.unique_seen(rows, ["node_id"], "ip", "ts", as_of, {"m5": 300, "h1": 3600, "h24": 86_400}), "recent": topk.by_recency(rows.groupBy("node_id", "ip").agg(F.max("ts").alias("last_seen")), "last_seen", "ip")}


def tcp_lz4(peers: DataFrame, totals: DataFrame) -> Tables:
    """Peer and global records within five seconds are one window; endpoints with the byte-weighted ratio, and window lengths."""
    p = F.col("p")
    rows = once(enveloped(peers), {"items": _items(p, "$")})
    bad = lambda x: ~F.coalesce(_text(x, "$[0][0]").isin("In", "Out"), F.lit(False)) | _text(x, "$[0][1]").isNull() | ~S.finite_nonneg(_num(x, "$[1]")) | ~S.finite_nonneg(_num(x, "$[2]")) | ~S.finite_nonneg(_num(x, "$[3]"))
    good, rejects = checked(rows, [*_envelope_checks(), ("rows", "no_list", F.col("items").isNull()), ("rows", "bad_row", validation.reject_if_any(F.col("items"), bad))])
    whole = enveloped(totals).filter("not bad_record and ts is not null").select("node_id", F.col("ts").alias("global_ts"), _num(p, "$[0]").alias("bytes"), _num(p, "$[1]").alias("packets"), _num(p, "$[2]").alias("ratio"))
    order = [F.greatest("ts", "global_ts").desc(), F.abs(micros("ts") - micros("global_ts")), F.col("ts").desc()]
    paired = joins.band_pair(whole, good.select("node_id", "ts", "items"), ["node_id"], "global_ts", "ts", vocab.PAIR_TOLERANCE_S, order, ["node_id", "global_ts"])
    x = F.col("x")
    each = paired.select("node_id", "global_ts", F.explode("items").alias("x")).select("node_id", "global_ts", F.lower(_text(x, "$[0][0]")).alias("direction"), S.canonical_ip(_text(x, "$[0][1]")).alias("ip"), _num(x, "$[1]").alias("bytes"), _num(x, "$[2]").alias("packets"), (_num(x, "$[3]") * _num(x, "$[1]")).alias("weighted"))
    ratio = F.coalesce(F.col("weighted") / F.nullif(F.col("bytes"), F.lit(0.0)), F.lit(0.0))
    top = topk.topn_plus_other(each, ["node_id", "global_ts", "direction"], "ip", "bytes", vocab.TRAFFIC_TOP, ["packets", "weighted"]).withColumn("ratio", ratio).drop("weighted")
    return {"lz4_endpoint": top, "lz4_global": W.window_duration(paired.select("node_id", "global_ts", "bytes", "packets", "ratio"), ["node_id"], "global_ts"), "rejects": rejects}


def tcp_sockets(rows: DataFrame, ports: Sequence[int]) -> DataFrame:
    """Census of parsed socket tables; a file with any bad row counts for nothing."""
    return A.socket_census(rows.filter("not bad"), ["node_id"], ports, vocab.SOCKET_STATES)


# --- pending transactions --------------------------------------------------------------------


def mempool_events(lines: DataFrame) -> Tables:
    """Events by closed kind with status and error kind, items of drops, and the newest sizes with the oldest age."""
    p = F.col("p")
    rows = once(enveloped(lines), {"e": json.tagged(p)})
    tag = F.col("e.tag")
    sizes = F.transform(_items(p, "$[1]"), lambda x: F.struct(_text(x, "$[0]").alias("name"), _int(x, "$[1]").alias("size")))
    pending = F.transform(_items(p, "$[2]"), lambda x: S.parse_ts(_text(x, "$[1]")))
    rows = once(rows, {"sizes": F.when(tag == "Size stats", sizes), "pending": F.when(tag == "Size stats", pending)})
    named = F.map_from_arrays(F.transform("sizes", lambda s: s["name"]), F.transform("sizes", lambda s: s["size"]))
    shapes = {"add_tx": F.col("e.arity") >= 4, "verify_block": F.col("e.arity") >= 3, "committed": F.col("e.arity") >= 5, "dropping blocks": _items(p, "$[1]").isNotNull(), "dropping txs": _items(p, "$[1]").isNotNull(), "Size stats": F.size("sizes") == len(vocab.MEMPOOL_SIZES)}
    good, rejects = checked(rows, [
        *_envelope_checks(), ("event", "no_tag", tag.isNull()), ("payload", "bad_shape", validation.tagged_failure(tag, shapes).isNotNull()),
        ("size_stats", "bad_name", F.exists("sizes", lambda s: ~F.coalesce(s["name"].isin(vocab.MEMPOOL_SIZES), F.lit(False)))), ("size_stats", "count_mismatch", (tag == "Size stats") & (named["uncommitted_txs"] != F.size("pending"))),
        ("size_stats", "arrival_after_record", F.exists("pending", lambda t: t > F.col("ts"))),
    ])
    status = F.when(tag == "add_tx", _text(p, "$[3]")).when(tag == "verify_block", _text(p, "$[2]"))
    error = F.map_keys(json.req(p, "$[4]", "object"))[0]
    items = F.when(tag.isin("dropping blocks", "dropping txs"), F.size(_items(p, "$[1]"))).when(tag == "Pruned rpc request throttle", _int(p, "$[1]") - _int(p, "$[2]")).otherwise(0)
    events = good.select("node_id", S.categorize(tag, vocab.MEMPOOL_EVENTS).alias("event"), F.when(status.isNull(), "none").otherwise(S.normalize_vocab(status, ["ok", "err"])).alias("status"), F.when(status == "err", S.categorize(error, vocab.MEMPOOL_ERRORS)).alias("error"), items.cast("long").alias("items"))
    counted = events.groupBy("node_id", "event", "status", "error").agg(F.count(F.lit(1)).alias("n"), F.sum("items").alias("items"))
    newest = A.latest_per_key(good.filter("sizes is not null").select("node_id", "ts", "sizes", "pending"), ["node_id"], ["ts"])
    return {"mempool_event": counted, "mempool_size": newest.select("node_id", "ts", named.alias("sizes"), S.nonneg_age(F.array_min("pending"), F.col("ts")).alias("oldest_s")), "rejects": rejects}


def mempool_txs(lines: DataFrame) -> Tables:
    """Actions and operations per record, orders by side and time in force, triggers apart."""
    p = F.col("p")
    rows = once(enveloped(lines), {"signed": _items(p, "$.signed_actions")})
    acts = F.transform("signed", lambda a: F.struct(_text(a, "$.action.type").alias("type"), _items(a, "$.action.orders").alias("orders"), _items(a, "$.action.cancels").alias("cancels"), _items(a, "$.action.modifies").alias("modifies")))
    rows = once(rows, {"acts": acts})
    needs = lambda a: ((a["type"] == "order") & a["orders"].isNull()) | (a["type"].isin("cancel", "cancelByCloid") & a["cancels"].isNull()) | ((a["type"] == "batchModify") & a["modifies"].isNull())
    good, rejects = checked(rows, [*_envelope_checks(), ("record", "no_hash", _text(p, "$.tx_hash").isNull()), ("actions", "no_list", F.col("signed").isNull()), ("action", "no_type", F.exists("acts", lambda a: a["type"].isNull())), ("operation", "no_list", F.exists("acts", needs))])
    flat = good.select("node_id", "ts", F.inline("acts"))
    ops = flat.select("node_id", S.normalize_vocab(F.col("type"), list(vocab.ACTION_CATEGORIES)).alias("action"), S.operation_count(F.col("type"), F.col("orders"), F.col("cancels"), F.col("modifies")).alias("operations"))
    orders = flat.select("node_id", F.explode(F.concat(F.coalesce("orders", F.array().cast("array<variant>")), F.transform(F.coalesce("modifies", F.array().cast("array<variant>")), lambda m: F.try_variant_get(m, "$.order", "variant")))).alias("o"))
    o = F.col("o")
    buy = json.req(o, "$.b", "bool")
    side = F.when(buy, "buy").when(~buy, "sell").otherwise("unknown")
    tif = _text(o, "$.t.limit.tif")
    kind = F.when(F.try_variant_get(o, "$.t.trigger", "variant").isNotNull(), "trigger").when(tif.isNull(), "unknown").otherwise(S.normalize_vocab(tif, vocab.TIME_IN_FORCE))
    sizes = good.select("node_id", F.size("signed").alias("actions"))
    return {
        "mempool_tx": ops.groupBy("node_id", "action").agg(F.count(F.lit(1)).alias("actions"), F.sum("operations").alias("operations")), "mempool_order": A.counter(orders.select("node_id", side.alias("side"), kind.alias("tif")), ["node_id", "side", "tif"]),
        "mempool_hist": A.explicit_histogram(sizes, "actions", vocab.MEMPOOL_ACTIONS, ["node_id"]), "mempool_bytes": lines.groupBy("node_id").agg(F.sum(F.octet_length("line") + 1).alias("bytes")), "rejects": rejects,
    }


# --- node state ------------------------------------------------------------------------------


def visor_state(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """Snapshot documents ``(node_id, mtime, doc)``, the newest history record where a node has none; bad optional values are missing."""

    def project(rows: DataFrame, v: Column, ts: Column) -> DataFrame:
        made = rows.select("node_id", ts.alias("ts"), *[_int(v, f"$.{c}").alias(c) for c in ("initial_height", "height", "scheduled_freeze_height", "hardfork_version")], *[S.parse_ts(_text(v, f"$.{c}")).alias(c) for c in ("consensus_time", "wall_clock_time")], _num(v, "$.reference_lag_seconds").alias("reference_lag_s"))
        return A.latest_per_key(made.filter("height is not null"), ["node_id"], ["ts"])

    e = enveloped(history).filter("not bad_record and ts is not null")
    now = joins.coalesce_sources(project(snapshots, F.col("doc"), F.col("mtime")), project(e, F.col("p"), F.col("ts")), ["node_id"])
    skew = (micros("consensus_time") - micros("wall_clock_time")) / 1e6
    return now.withColumns({"consensus_minus_wall_s": skew, "blocks_applied": S.nonneg_diff(F.col("height"), F.col("initial_height")), "freeze_scheduled": F.col("scheduled_freeze_height").isNotNull(), "lag_known": F.col("reference_lag_s").isNotNull()})


def node_state(ints: DataFrame, visor: DataFrame) -> DataFrame:
    """Integer files ``(node_id, name, value)``: freeze and checkpoint heights and the height above the freeze, absent without a height."""
    wide = ints.groupBy("node_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("freeze_height", "checkpoint_fast", "checkpoint_slow")])
    joined = wide.join(visor.select("node_id", "height"), "node_id", "left")
    return joined.withColumns({"above_freeze": S.nonneg_diff(F.col("height"), F.col("freeze_height")), "fast_slow_gap": S.nonneg_diff(F.col("checkpoint_fast"), F.col("checkpoint_slow"))})


def snapshot_status(inventory: DataFrame) -> DataFrame:
    """Sentinel files ``<date>/<height>`` of the two newest dates."""
    rows = inventory.withColumns({"date": S.path_date(F.regexp_extract("path", r"/(\d{8})/(\d+)$", 1)), "height": F.regexp_extract("path", r"/(\d{8})/(\d+)$", 2).try_cast("long")}).filter("date is not null and height is not null and is_regular")
    return A.sentinel_window(rows, ["node_id"], "date", "height", "mtime")


def markers(inventory: DataFrame) -> Tables:
    """Directory names ``<height>_<time>`` (replays) and ``<time>`` (runs)."""
    name = S.basename(F.col("path"))
    dirs = inventory.filter("is_dir")
    return {"replay_marker": A.retained_markers(dirs, ["node_id"], S.parse_ts(F.regexp_extract(name, r"^\d+_(.+)$", 1)), "mtime"), "run_marker": A.retained_markers(dirs, ["node_id"], S.parse_ts(name), "mtime")}


_STATS = ["mean", "med", "p90", "p95", "max", "std_dev"]


def latency_summaries(lines: DataFrame, keys: Sequence[str], allowed: Sequence[str], as_of: Column, max_age_s: int = 900) -> Tables:
    """Lines with the columns ``keys`` (subsystem, and step): the newest fresh summary, and its statistics one a row."""
    v = F.col("v")
    fields = ["total_n", "total_mean", *_STATS, "work_frac"]
    rows = once(validation.allow(records(lines), keys[-1], allowed), {"ts": S.parse_ts(_text(v, "$.time")), **{f: _num(v, f"$.{f}") for f in fields}})
    finite = F.lit(True)
    for f in fields:
        finite = finite & F.coalesce(~F.isnan(f) & (F.abs(f) < float("inf")), F.lit(False))
    good, rejects = checked(rows, [("record", "bad_json", v.isNull()), ("record", "bad_time", F.col("ts").isNull()), ("record", "bad_number", ~finite)])
    newest = A.latest_per_key(good.select("node_id", *keys, "ts", *fields), ["node_id", *keys], ["ts"]).filter(S.fresh(F.col("ts"), as_of, max_age_s))
    return {"subsystem_latency": newest, "step_latency": newest.unpivot(["node_id", *keys, "ts"], _STATS, "quantile", "value"), "rejects": rejects}


def tokio_tasks(lines: DataFrame, allowed: Sequence[str], as_of: Column) -> Tables:
    """Task samples of the newest record of each task; a node's own suffix is cut from the name."""
    p = F.col("p")
    rows = once(enveloped(lines), {"task": S.cut_at(_text(p, "$.task_name"), " home_validator="), "dropped": _int(p, "$.dropped_count"), "idle_s": _num(p, "$.total_idle_duration"), "scheduled": _int(p, "$.total_scheduled_count")})
    good, rejects = checked(rows, [*_envelope_checks(), ("task", "no_name", F.col("task").isNull()), ("task", "bad_number", ~S.finite_nonneg(F.col("idle_s")) | F.col("dropped").isNull() | F.col("scheduled").isNull())])
    rows = validation.allow(good, "task", allowed).select("node_id", "task", "ts", "dropped", "idle_s", "scheduled")
    return {"task_sample": A.latest_per_key(rows, ["node_id", "task"], ["ts"]).filter(S.fresh(F.col("ts"), as_of, 900)), "rejects": rejects}


def critical_messages(counts: DataFrame, rich: DataFrame) -> Tables:
    """Daily counters with ``source`` and ``landed``, and rich documents ``(node_id, source, mtime, doc)`` of the same generation."""
    p = F.col("p")
    rows = once(enveloped(counts), {"base": S.parse_ts(_text(p, "$[0]")), "bugs": _int(p, "$[1]"), "crits": _int(p, "$[2]"), "locations": _int(p, "$[3]")})
    good, rejects = checked(rows, [*_envelope_checks(), ("counts", "bad_row", F.col("base").isNull() | F.col("bugs").isNull() | F.col("crits").isNull() | F.col("locations").isNull())])
    now = A.latest_per_key(good.select("node_id", "source", "ts", "landed", "base", "bugs", "crits", "locations"), ["node_id", "source"], ["ts"])
    doc = F.col("doc")
    detailed = rich.select("node_id", "source", "mtime", S.parse_ts(_text(doc, "$.start_time")).alias("base"), _int(doc, "$.n_bugs").alias("bugs"), _int(doc, "$.n_crits").alias("crits"), _items(doc, "$.code_location_and_stats").alias("items")).withColumn("locations", F.size("items").cast("long"))
    same = joins.match_generations(now, detailed, ["node_id", "source", "base", "bugs", "crits", "locations"], "landed", "mtime", vocab.CRITICAL_SKEW_S)
    x = F.col("x")
    each = same.select("node_id", "source", F.explode("items").alias("x")).select("node_id", "source", F.struct(S.basename(_text(x, "$[0].fln")).alias("file"), _int(x, "$[0].line").alias("line")).alias("place"), _int(x, "$[1].n").alias("n"))
    best = each.groupBy("node_id", "source", "place").agg(F.max("n").alias("n"))
    top = topk.rank_with_ties(best, ["node_id", "source"], "n", "place").filter(F.col("rank") <= vocab.LOCATION_CAP)
    return {"crit_generation": now, "crit_location": top.select("node_id", "source", "place.*", "n"), "rejects": rejects}


def log_volume(lines: DataFrame) -> DataFrame:
    """Committed lines with ``stream``, ``level`` and ``file_date``."""
    return A.log_volume(lines, ["node_id", "stream", "level"], "file_date")


def child_stderr(heads: DataFrame) -> DataFrame:
    """First bytes ``(node_id, state, head, mtime)``: files by state and reason over the whole census."""
    reason = F.when(F.col("state").isin("empty", "unreadable"), "none").otherwise(S.classify_text(F.col("head"), vocab.STDERR_CLASSES))
    counted = heads.withColumn("reason", reason).groupBy("node_id", "state", "reason").agg(F.count(F.lit(1)).alias("files"), F.max("mtime").alias("newest"))
    reasons = [c for c, _ in vocab.STDERR_CLASSES] + ["unknown", "none"]
    census = A.with_census(counted.select("node_id").distinct(), {"state": ("empty", "readable", "truncated", "unreadable"), "reason": reasons})
    return census.join(counted, ["node_id", "state", "reason"], "left").select("node_id", "state", "reason", F.coalesce("files", F.lit(0)).alias("files"), "newest")


def rate_limit_files(inventory: DataFrame, as_of: Column, recent_s: int = 120) -> DataFrame:
    age = micros(as_of) - micros("mtime")
    return inventory.groupBy("node_id", "stream").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(((age >= 0) & (age <= recent_s * 1_000_000)).cast("long")).alias("recent"), F.max(S.exclude_future(F.col("mtime"), as_of)).alias("newest"))


def optional_streams(tails: DataFrame, as_of: Column) -> DataFrame:
    """Tails ``(node_id, stream, mtime, valid)``: presence, validity and age of each stream."""
    newest = A.latest_per_key(tails.select("node_id", "stream", "mtime", "valid"), ["node_id", "stream"], ["mtime"])
    return newest.withColumn("age_s", S.nonneg_age(F.col("mtime"), as_of))


def operator_config(inventory: DataFrame, known: Sequence[str], as_of: Column) -> DataFrame:
    """Tracked files by known name, with failed-load companions (``<name>.failed...``)."""
    base = S.basename(F.col("path"))
    failed = F.contains(base, F.lit(".failed"))
    rows = inventory.withColumn("file", S.normalize_vocab(S.cut_at(base, ".failed"), known, "unknown")).withColumn("failed", failed)
    return rows.groupBy("node_id", "file").agg(F.sum((~F.col("failed")).cast("long")).alias("present"), F.sum(F.col("failed").cast("long")).alias("failed_loads"), F.min(S.nonneg_age(F.col("mtime"), as_of)).alias("age_s"))


def public_ip_changes(documents: DataFrame, as_of: Column) -> DataFrame:
    """Address documents over time ``(node_id, mtime, doc)``."""
    rows = documents.select("node_id", "mtime", S.canonical_ip(F.coalesce(_text(F.col("doc"), "$.ip"), _text(F.col("doc"), "$"))).alias("ip")).filter("ip is not null")
    last = rows.groupBy("node_id").agg(F.max_by("ip", "mtime").alias("ip"), F.max("mtime").alias("mtime"))
    return W.change_count(rows, ["node_id"], ["mtime"], "ip").join(last.withColumn("age_s", S.nonneg_age(F.col("mtime"), as_of)), "node_id")


def disk_scopes(inventory: DataFrame, scopes: Mapping[str, str]) -> DataFrame:
    return A.disk_usage(inventory, ["node_id"], scopes)


def tmp_usage(inventory: DataFrame, classes: Sequence[tuple[str, Sequence[str]]], as_of: Column) -> DataFrame:
    rows = inventory.filter("is_regular").withColumn("class", S.classify_text(S.basename(F.col("path")), classes, "other", "other"))
    return A.classed_file_stats(rows, ["node_id", "class"], as_of)


def process_samples(samples: DataFrame) -> Tables:
    """The oldest eligible process of each name, and increases of its IO counters within one life."""
    io = ["read_bytes", "write_bytes", "read_sys", "write_sys"]
    chosen = samples.groupBy("node_id", "ts", "name").agg(F.count(F.lit(1)).alias("eligible"), F.min_by(F.struct(*[c for c in samples.columns if c not in ("node_id", "ts", "name")]), F.struct("start_ticks", "pid")).alias("x")).select("node_id", "ts", "name", "eligible", "x.*")
    return {"process_sample": chosen, "process_io": W.positive_delta(chosen.withColumns({c: F.col(c).cast("double") for c in io}), ["node_id", "name"], ["pid", "start_ticks"], ["ts"], io)}


def rocksdb_stats(blocks: DataFrame, reasons: Sequence[str]) -> Tables:
    """The newest complete statistics blocks ``(node_id, db, block)``: stalls by reason and cache use in bytes."""
    text = F.regexp_extract("block", r"Write Stall \(count\): ([^\n]+)", 1)
    stalls = blocks.select("node_id", "db", F.explode(F.str_to_map(text, F.lit(", "), F.lit(": "))).alias("reason", "n")).withColumn("n", F.col("n").try_cast("long")).filter(F.col("reason").isin(list(reasons)))
    cache = blocks.select("node_id", "db", S.byte_size(F.regexp_extract("block", r"Block cache LRUCache@\S+.*?usage: ([0-9.]+ [KMGT]?B)", 1)).alias("cache_bytes"))
    return {"rocksdb_stall": stalls, "rocksdb_cache": cache}


def exchange_delta(responses: DataFrame) -> Tables:
    """Recorded answers ``(node_id, received, line)``: local receipt minus the exchange's time, and outcomes."""
    v = json.record(F.col("line"))
    t = F.timestamp_millis(_int(v, "$.time"))
    rows = responses.withColumns({"exchange_time": t, "outcome": F.when(v.isNull(), "bad_json").when(t.isNull(), "bad_time").otherwise("success")})
    good = rows.filter("outcome = 'success'").withColumn("delta_s", (micros("received") - micros("exchange_time")) / 1e6)
    return {"info_probe": A.latest_per_key(good.select("node_id", "received", "delta_s"), ["node_id"], ["received"]), "outcomes": A.counter(rows, ["node_id", "outcome"])}
