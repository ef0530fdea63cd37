import datetime as dt
import json as js

import pytest
from pyspark.sql import functions as F

from nodelytics.plans import jobs, telemetry_jobs
from nodelytics.sources import readers, sinks

TS = "2026-05-25T10:37:{:02d}.672768629"
A, B, C = ("0x" + c * 40 for c in "abc")


def as_of():
    return F.lit(dt.datetime(2026, 5, 25, 11)).cast("timestamp")


def lines(spark, values, **extra):
    rows = [{"node_id": "n1", "line": v if isinstance(v, str) else js.dumps(v), **extra} for v in values]
    return spark.createDataFrame(rows, ", ".join(["node_id string", "line string", *(f"{k} string" for k in extra)]))


def reasons(tables):
    return sorted(r.reason for r in tables["rejects"].collect())


def test_core_blocks(spark):
    block = lambda h, s: {"height": h, "block_time": TS.format(s), "begin_block_wall_time": "", "apply_duration": 0.5}
    made = jobs.core_blocks(lines(spark, [block(1, 1), block(2, 2), block(2, 3), block(5, 4), block(6, 3), "{", block(-1, 9), block(9, 9) | {"apply_duration": -1}], state_type="fast").withColumn("seq", F.monotonically_increasing_id()))
    assert [r.height for r in made["core_block"].orderBy("height").collect()] == [1, 2, 5]
    assert reasons(made) == ["bad_duration", "bad_height", "bad_json"] and made["core_height"].first().height == 5
    assert {(r.le, r.bucket) for r in made["core_block_hist"].collect()} >= {("1000", 1), ("2000", 2), ("+Inf", 2)}


def test_replica_blocks(spark):
    def block(h, actions, **more):
        bundle = [["h", {"signed_actions": [{"action": a} for a in actions]}]] if actions is not None else []
        return {"height": h, "abci_block": {"time": TS.format(1), "round": h, "parent_round": h - 1, "proposer": A, "signed_action_bundles": bundle}, **more}

    good = block(1, [{"type": "order", "orders": [1, 2]}, {"type": "cancel", "cancels": [1]}, {"type": "newThing"}, {"type": "multiSig", "payload": {"action": {"type": "order"}}}], resps={"Full": [["h", [{"user": A, "res": {"status": "ok"}}, {"user": A, "res": {"status": "err"}}]]]})
    made = jobs.replica_blocks(lines(spark, [good, block(2, None), block(3, []), block(0, None), block(4, [{"type": "order"}])]))
    got = {r.height: (r.bundles, r.actions, r.operations, r.orders) for r in made["replica_block"].collect()}
    assert got == {1: (1, 4, 5, 2), 2: (0, 0, 0, 0)} and reasons(made) == ["bad_height", "no_actions", "no_list"]
    assert {(r.action, r.category, r.operations) for r in made["replica_action"].collect()} >= {("order", "trading", 2), ("newThing", "other", 1)}
    r = made["replica_response"].filter("height = 1").first()
    assert (r.coverage, r.relation, r.ok, r.err) == ("available", "fewer", 1, 1) and made["proposal"].first().blocks == 2
    assert jobs.proposals(lines(spark, [good])).first().proposer == A


def test_evm_blocks(spark):
    def block(n, txs, receipts, used="0x5"):
        head = {"number": hex(n), "gasLimit": "0xa", "gasUsed": used, "timestamp": hex(1000 + n), "baseFeePerGas": hex(10**9)}
        return [TS.format(1), {"block": {"V1": {"header": {"hash": "0x1", "header": head}, "body": {"transactions": [{"transaction": t} for t in txs]}}}, "receipts": receipts, "system_txs": [], "read_precompile_calls": [[A, [[{}, {"Ok": {}}], [{}, {"Err": {}}]]]]}]

    one = {"Eip1559": {"maxFeePerGas": hex(5 * 10**9), "maxPriorityFeePerGas": hex(2 * 10**9), "to": None}}
    two = {"Legacy": {"gasPrice": hex(4 * 10**9), "to": A}}
    made = jobs.evm_blocks(lines(spark, [block(1, [one, two], [{"success": True}, {"success": False}]), block(3, [two], []), block(4, [], [], "0xff"), ["x"]]))
    got = {r.number: (r.txs, r.gas_ratio, r.max_priority_gwei, r.mismatch, r.gap_ms) for r in made["evm_block"].collect()}
    assert got == {1: (2, 0.5, 3.0, False, None), 3: (1, 0.5, 3.0, True, 2000.0)}
    assert {(r.type, r["shape"], r.n) for r in made["evm_tx_types"].collect()} == {("Eip1559", "create", 1), ("Legacy", "message", 2)}
    assert reasons(made) == ["bad_envelope", "bad_gas"] and (made["evm_receipt"].first().success, made["evm_receipt"].first().failed) == (1, 1)


def test_consensus(spark):
    block = lambda r, signers, d="in": [TS.format(r), [d, {"source": A, "msg": {"Block": {"round": r, "proposer": A, "hash": f"h{r}", "qc": {"round": r, "block_hash": "q", "signers": signers}, "tc": None}}}]]
    made = jobs.consensus_events(lines(spark, [block(1, [A, B]), block(1, [A, B], "out"), block(2, [A]), [TS.format(3), ["in", {"source": B, "msg": {"Vote": {"vote": {"round": 2, "validator": B}}}}]], [TS.format(4), ["round advance", {"prev_round": 1, "round": 3, "reason": {"Tc": {}}}]], [TS.format(5), ["status", {"round": 9, "last_vote_round": 8, "last_commit_round": 7, "qc_round": 8}]], [TS.format(6), ["execution state", {"round": 5}]], [TS.format(7), ["in", {"msg": {}}]]]))
    assert made["consensus_block"].count() == 2 and {(r.direction, r.n) for r in made["directions"].collect()} == {("in", 2), ("out", 1)}
    assert {r.signer[-4:]: r.rate for r in made["qc_signer"].collect()} == {"aaaa": 100.0, "bbbb": 50.0}
    assert made["consensus_vote"].first().round == 2 and made["round_advance"].first().reason == "tc" and made["execution"].first().execution_lag == 4
    assert made["round_state"].first().round_minus_last_commit_round == 2 and reasons(made) == ["bad_variant"]


def test_heartbeats(spark):
    big = 2**63 + 5
    beat = lambda i, s: [TS.format(s), ["out", {"Heartbeat": {"validator": A, "random_id": i, "round": 7}}]]
    ack = lambda i, s, src: [TS.format(s), ["in", {"source": src, "msg": {"HeartbeatAck": {"validator": A, "random_id": i, "round": 7}}}]]
    made = jobs.heartbeat_join(lines(spark, [beat(big, 1), ack(big, 2, B), ack(big, 3, B), ack(big, 4, A), ack(99, 5, B), beat(4, 6)]), as_of())
    assert {(r.kind, r.outcome, r.n) for r in made["outcomes"].collect()} == {("peer", "matched", 1), ("peer", "mismatch", 1), ("self", "matched", 1), ("peer", "orphan", 1)}
    assert made["heartbeat_expired"].count() == 1


def test_status(spark):
    row = [TS.format(1), {"round": 5, "heartbeat_statuses": [[A, {"since_last_success": 1.0, "last_ack_duration": None}]], "disconnected_validators": [[A, [[B, 4]]]], "validators_missing_heartbeat": [B, C]}]
    dup = [TS.format(2), {"round": 6, "heartbeat_statuses": [[A, {}], ["0xaaaa..aaaa", {}]]}]
    made = jobs.consensus_status(lines(spark, [row, dup, [TS.format(3), {"round": 7, "heartbeat_statuses": None}], [TS.format(4), {"round": 8, "heartbeat_statuses": [[A, {}], [A, {}]]}]]))
    assert made["status_heartbeat"].first().ack_presence == "null" and reasons(made) == ["alias_conflict", "bad_list", "duplicate"]
    alike = jobs.consensus_status(lines(spark, [[TS.format(1), {"round": 5, "heartbeat_statuses": [["0x" + "ab" * 20, {}], ["0xab" + "cd" * 17 + "abab", {}]]}]]))
    assert alike["status_heartbeat"].count() == 2 and reasons(alike) == []  # different full addresses do not conflict
    s = jobs.status_summary(made, spark.createDataFrame([("0xbbbb..bbbb",)], "validator string")).first()
    assert (s.missing, s.disconnected) == (1, 1)
    made = jobs.validator_status(lines(spark, [[TS.format(1), {"home_validator": A, "current_stakes": [[A, 5.0]], "current_jailed_validators": [B]}], [TS.format(2), {"home_validator": A, "current_stakes": [[A, B]]}], [TS.format(3), {"current_stakes": [[A, 1.0], [A, B]]}]]))
    assert made["status_stake"].count() == 0 and made["signer_map"].count() == 1 and made["status_jailed"].count() == 1 and reasons(made) == ["mixed_rows"]


def test_validators(spark):
    lat = jobs.validator_latency(lines(spark, [{"time": TS.format(1), "round": 1, "latency": 0.5}, {"time": TS.format(2), "round": 2, "latency": 0.1}, {"time": "x", "round": 1, "latency": 1.0}], validator=A))
    assert lat["validator_latency"].first().latency == 0.1 and [r.peak for r in lat["latency_peak"].collect()] == [0.5] and reasons(lat) == ["bad_time"]
    ema = jobs.validator_ema(lines(spark, [[TS.format(1), [[A, 0.2], [B, 0.4]]], [TS.format(2), [[A, 0.0]]], [TS.format(3), [[A, 0.1], [A, 0.2]]]]))
    assert sorted(r.state for r in ema["ema_state"].collect()) == ["initializing", "measured"] and reasons(ema) == ["duplicate"]
    acc = jobs.accumulators(lines(spark, [{"time": TS.format(1), "n": 1, "delta": 2.5}, {"time": TS.format(2), "n": 1, "delta": -1.0}], bucket="RoundQc"), ["RoundQc"])
    assert acc["accumulator"].first().total == 2.5
    row = lambda v, s, **m: {"validator": v, "signer": s, "name": " ", "nRecentBlocks": 1, "stake": 5.0, "isJailed": False, "isActive": True, "unjailableAfter": 0, "commission": "0.04", "stats": [["day", {"uptimeFraction": "0.9", "predictedApr": ""}]], **m}
    docs = spark.createDataFrame([("n1", 1, js.dumps([row(A, B), row(B, C, isJailed=True, isActive=False)])), ("n1", 2, js.dumps([row(A, B), row(A, C)]))], "node_id string, generation int, text string").withColumn("doc", F.try_parse_json("text"))
    made = jobs.validator_summaries(docs)
    t = made["stake_totals"].first()
    assert (t.generation, t.total_sum, t.eligible_n, t.jailed_n) == (1, 10.0, 1, 1) and made["validator_period"].first().apr is None
    prof = spark.createDataFrame([("n1", "d1", 1, "0xaaaa..aaaa", "m", "192.0.2.1", False), ("n1", "d1", 2, "0xaaaa..aaaa", "m", "192.0.2.1", False), ("n1", "d2", 1, A, "", "192.0.2.1", True), ("n2", "d0", 9, A, "m", "192.0.2.2", False)], "node_id string, day string, height long, address string, moniker string, ip string, legacy boolean")
    made = jobs.validator_profiles(prof, spark.createDataFrame([(A,)], "validator string"))
    assert {(r.node_id, r.address, r.ip) for r in made["validator_profile"].collect()} == {("n1", A, "192.0.2.1"), ("n2", A, "192.0.2.2")}
    assert {(r.node_id, r.day, r.height, r["count"]) for r in made["validator_daily"].collect()} == {("n1", "d1", 2, 1), ("n2", "d0", 9, 1)}


def test_network(spark):
    req, resp = {"content": {"BlocksAndTxs": {"a": 1, "b": 2}}, "query_peers": False}, {"Ok": {"BlocksAndTxs": {"n": 3}}}
    again = {"query_peers": False, "content": {"BlocksAndTxs": {"b": 2, "a": 1}}}
    e = [["Incoming tcp stream", "s", "ep"], ["Received rpc request", "s", req], ["Rpc task inbound", again], ["Rpc task response", req, resp], ["Outbound response", "s", again, resp], ["new tag", 1]]
    made = telemetry_jobs.consensus_rpc(lines(spark, [[TS.format(i), x] for i, x in enumerate(e)]))
    assert [(r.session, r.duration_s) for r in made["rpc_served"].collect()] == [("s", 4.0)] and {r.event for r in made["rpc_event"].collect()} >= {"unknown_tag"}
    conn = telemetry_jobs.validator_connections(lines(spark, [[TS.format(1), ["handle_stream_connection", "e", "mempool"]], [TS.format(1), ["x", "e", "y"]]]), ["mempool"])
    assert {(r.event, r.subsystem) for r in conn["validator_conn_event"].collect()} == {("handle_stream_connection", "mempool"), ("other", "other")}
    kids = telemetry_jobs.gossip_children(lines(spark, [[TS.format(1), ["child_peers status", [[{"Ip": "192.0.2.1"}, {"verified": True, "connection_count": 2}], ["::ffff:192.0.2.2", {"verified": False, "connection_count": 1}]]]], [TS.format(2), ["child_peers status", [["192.0.2.1", {}], ["192.0.2.1", {}]]]]]))
    s = kids["child_summary"].first()
    assert (s.verified, s.unverified, s.connections, s.overflow) == (1, 1, 3, 0) and reasons(kids) == ["duplicate"]
    ev = telemetry_jobs.gossip_events(lines(spark, [[TS.format(1), ["dropping connection", {"Ip": "192.0.2.1"}]], [TS.format(1), ["dropping connection"]], [TS.format(1), ["future tag"]]]))
    assert {r.event: r.n for r in ev["gossip_event"].collect()} == {"dropping_connection": 1, "other": 1} and reasons(ev) == ["bad_shape"]


def test_traffic(spark):
    snap = lambda s, v: [TS.format(s), [[["In", "192.0.2.1", 4001], v], [["In", "192.0.2.1", 9], 1.0], [["Out", "192.0.2.2", 4001], 0.0]]]
    made = telemetry_jobs.tcp_traffic(lines(spark, [snap(1, 5.0), snap(2, 6.0), snap(2, 6.0), [TS.format(3), [[["Up", "192.0.2.1", 1], 1.0]]]]), [4001])
    assert {(r.ts.second, r.label, r.value) for r in made["traffic_endpoint"].filter("direction = 'in'").collect()} == {(1, "192.0.2.1", 6.0), (2, "192.0.2.1", 7.0)}
    assert [r.n for r in made["active"].orderBy("ts").collect()] == [1, 1] and reasons(made) == ["bad_row"]
    assert [r.dominant for r in jobs.dominant_inbound(made["endpoints"].filter("direction = 'in'")).collect()] == ["192.0.2.1"] * 2
    kept = telemetry_jobs.endpoint_set(made["endpoints"], as_of())
    assert [(r.ip, r.added) for r in kept["endpoint_set"].collect()] == [("192.0.2.1", True)] and kept["seen"].first().h1 == 1
    peers = lines(spark, [[TS.format(1), [[["In", "192.0.2.1", 1], 10.0, 1.0, 0.5], [["In", "192.0.2.1", 2], 30.0, 1.0, 0.9]]]])
    lz4 = telemetry_jobs.tcp_lz4(peers, lines(spark, [[TS.format(3), [40.0, 2.0, 0.7]], [TS.format(30), [1.0, 1.0, 1.0]]]))
    r = lz4["lz4_endpoint"].first()
    assert (r.label, r.bytes, round(r.ratio, 6)) == ("192.0.2.1", 40.0, 0.8) and lz4["lz4_global"].count() == 1


def test_mempool(spark):
    rows = [["add_tx", "h", True, "ok"], ["add_tx", "h", True, "err", {"AddTxDuplicate": {}}], ["dropping txs", [["t", "h"]]], ["Size stats", [["committed_tx_hashes", 1], ["uncommitted_txs", 1], ["blocks", 2], ["rpc_requests", 0]], [["h", TS.format(1)]]], ["Size stats", [["committed_tx_hashes", 1], ["uncommitted_txs", 3], ["blocks", 2], ["rpc_requests", 0]], []], ["brand new"]]
    made = telemetry_jobs.mempool_events(lines(spark, [[TS.format(5), x] for x in rows]))
    assert {(r.event, r.status, r.error, r.n, r["items"]) for r in made["mempool_event"].collect()} >= {("add_tx", "err", "add_tx_duplicate", 1, 0), ("dropping_txs", "none", None, 1, 1), ("other", "none", None, 1, 0)}
    s = made["mempool_size"].first()
    assert s.sizes["blocks"] == 2 and s.oldest_s == 4.0 and reasons(made) == ["count_mismatch"]
    order = lambda b, t: {"b": b, "t": t}
    txs = telemetry_jobs.mempool_txs(lines(spark, [[TS.format(1), {"tx_hash": "h", "signed_actions": [{"action": {"type": "order", "orders": [order(True, {"limit": {"tif": "Gtc"}}), order(False, {"trigger": {}})]}}]}], [TS.format(1), {"signed_actions": []}]]))
    assert {(r.side, r.tif) for r in txs["mempool_order"].collect()} == {("buy", "Gtc"), ("sell", "trigger")} and reasons(txs) == ["no_hash"] and txs["mempool_tx"].first().operations == 2


def test_state_and_files(spark):
    doc = {"initial_height": 5, "height": 9, "scheduled_freeze_height": None, "hardfork_version": "bad", "consensus_time": TS.format(5), "wall_clock_time": TS.format(4), "reference_lag_seconds": 0.5}
    snaps = spark.createDataFrame([("n1", dt.datetime(2026, 5, 25), js.dumps(doc))], "node_id string, mtime timestamp, text string").withColumn("doc", F.try_parse_json("text"))
    history = spark.createDataFrame([("n1", js.dumps([TS.format(1), doc | {"height": 1}])), ("n2", js.dumps([TS.format(1), doc]))], "node_id string, line string")
    visor = telemetry_jobs.visor_state(snaps, history)
    got = {r.node_id: (r.height, r.blocks_applied, r.hardfork_version, r.consensus_minus_wall_s) for r in visor.collect()}
    assert got == {"n1": (9, 4, None, 1.0), "n2": (9, 4, None, 1.0)}
    ints = spark.createDataFrame([("n1", "freeze_height", 12), ("n1", "checkpoint_fast", 9), ("n1", "checkpoint_slow", 4), ("n3", "freeze_height", 1)], "node_id string, name string, value long")
    state = {r.node_id: (r.above_freeze, r.fast_slow_gap) for r in telemetry_jobs.node_state(ints, visor).collect()}
    assert state == {"n1": (0, 5), "n3": (None, None)}
    t = lambda h: dt.datetime(2026, 5, 24, h)
    inv = spark.createDataFrame([("n1", "/s/20260524/10", False, True, 0, t(1)), ("n1", "/s/20260524/9", False, True, 0, t(2)), ("n1", "/s/20260523/99", False, True, 0, t(0)), ("n1", "/s/20260522/999", False, True, 0, t(0)), ("n1", "/r/7_2026-05-24T01:00:00Z", True, False, 0, t(3)), ("n1", "/x/notes.failed-1", False, True, 5, t(4))], "node_id string, path string, is_dir boolean, is_regular boolean, size long, mtime timestamp")
    s = telemetry_jobs.snapshot_status(inv).first()
    assert (s["files"], s.height) == (3, 99) and telemetry_jobs.markers(inv)["replay_marker"].first().markers == 1
    conf = {r.file: (r.present, r.failed_loads) for r in telemetry_jobs.operator_config(inv.filter("path like '/x/%'"), ["notes"], as_of()).collect()}
    assert conf == {"notes": (0, 1)}
    tmp = {r["class"]: (r["files"], r.stale) for r in telemetry_jobs.tmp_usage(inv, [("log", ["notes"])], as_of()).collect()}
    assert tmp["log"] == (1, 1) and telemetry_jobs.rate_limit_files(inv.withColumn("stream", F.lit("a")), as_of()).first()["files"] == 6
    heads = spark.createDataFrame([("n1", "readable", "thread panicked at x", t(1)), ("n1", "empty", "", t(1)), ("n2", "readable", "panicked at y", t(2))], "node_id string, state string, head string, mtime timestamp")
    every = telemetry_jobs.child_stderr(heads).collect()
    census = {(r.state, r.reason): r["files"] for r in every if r.node_id == "n1"}
    assert len(every) == 2 * len(census) and {r["files"] for r in every if r.node_id == "n2" and r.reason == "panic" and r.state == "readable"} == {1}
    assert census["readable", "panic"] == 1 and census["empty", "none"] == 1 and census["truncated", "network"] == 0


def test_latency_tasks_and_critical(spark):
    rec = {"time": TS.format(1), "total_n": 5, "total_mean": 0.1, "mean": 0.1, "med": 0.1, "p90": 0.2, "p95": 0.3, "max": 0.4, "std_dev": 0.0, "work_frac": 1.5}
    now = F.lit(dt.datetime(2026, 5, 25, 10, 38)).cast("timestamp")
    made = telemetry_jobs.latency_summaries(lines(spark, [rec, rec | {"time": TS.format(2), "mean": 0.7}, rec | {"p90": None}], subsystem="proposer"), ["subsystem"], ["proposer"], now)
    assert made["subsystem_latency"].first()["mean"] == 0.7 and made["step_latency"].count() == 6 and reasons(made) == ["bad_number"]
    task = telemetry_jobs.tokio_tasks(lines(spark, [[TS.format(1), {"task_name": "job home_validator=V(0x1)", "dropped_count": 0, "total_idle_duration": 0.5, "total_scheduled_count": 3}]]), ["job"], now)
    assert task["task_sample"].first().task == "job"
    counts = lines(spark, [[TS.format(1), [TS.format(0), 1, 2, 2]]], source="s").withColumn("landed", F.lit(dt.datetime(2026, 5, 25, 10, 37)).cast("timestamp"))
    loc = lambda n, line, k: [{"fln": n, "line": line}, {"n": k, "is_ignored": False}]
    rich = spark.createDataFrame([("n1", "s", dt.datetime(2026, 5, 25, 10, 38), js.dumps({"start_time": TS.format(0), "n_bugs": 1, "n_crits": 2, "code_location_and_stats": [loc("a/x.rs", 1, 5), loc("b/x.rs", 1, 7)]}))], "node_id string, source string, mtime timestamp, text string").withColumn("doc", F.try_parse_json("text"))
    made = telemetry_jobs.critical_messages(counts, rich)
    assert [(r.file, r.line, r.n) for r in made["crit_location"].collect()] == [("x.rs", 1, 7)]
    db = spark.createDataFrame([("n1", "d", "x\nWrite Stall (count): total-stops: 3, other-thing: 9\nBlock cache LRUCache@0x1#1 capacity: 2.00 GB usage: 1.5 GB table")], "node_id string, db string, block string")
    made = telemetry_jobs.rocksdb_stats(db, ["total-stops"])
    assert [(r.reason, r.n) for r in made["rocksdb_stall"].collect()] == [("total-stops", 3)] and made["rocksdb_cache"].first().cache_bytes == 1.5 * 1024**3
    probe = telemetry_jobs.exchange_delta(spark.createDataFrame([("n1", dt.datetime(1970, 1, 1, 0, 0, 2), '{"time": 1500}'), ("n1", dt.datetime(1970, 1, 1), "x")], "node_id string, received timestamp, line string"))
    assert probe["info_probe"].first().delta_s == 0.5 and {r.outcome for r in probe["outcomes"].collect()} == {"success", "bad_json"}
    proc = spark.createDataFrame([("n1", i, "node", 7, 1, 10 * i, 0, 0, 0) for i in range(3)] + [("n1", 2, "node", 9, 5, 99, 0, 0, 0)], "node_id string, ts int, name string, pid int, start_ticks int, read_bytes int, write_bytes int, read_sys int, write_sys int")
    made = telemetry_jobs.process_samples(proc)
    assert [r.read_bytes_delta for r in made["process_io"].orderBy("ts").collect()] == [0.0, 10.0, 10.0] and made["process_sample"].filter("ts = 2").first().eligible == 2


def test_readers_and_sinks(spark, tmp_path):
    hour = tmp_path / "n1" / "core" / "hourly" / "20260525"
    hour.mkdir(parents=True)
    (hour / "10").write_text("a\nb\ntorn")
    rows = readers.read_hourly_stream(spark, str(tmp_path), "core").collect()
    assert {(r.node_id, r.file_date, r.file_hour, r.line) for r in rows} == {("n1", "20260525", "10", x) for x in ("a", "b", "torn")}
    good, torn = readers.drop_torn_tails(spark, f"{hour}/*")
    assert [r.line for r in good.orderBy("line_no").collect()] == ["a", "b"] and [r.line for r in torn.collect()] == ["torn"]
    assert readers.torn_tails(spark, str(hour)).count() == 1 and readers.split_long(readers.read_dated_logs(spark, f"{hour}/10"), 1)[1].count() == 1
    run = tmp_path / "n1" / "runs" / "2026-05-25T00:00:00Z" / "20260525"
    run.mkdir(parents=True)
    for h in ("9", "10"):
        (run / h).write_text("{}\n")
    assert sorted(r.height for r in readers.read_runs(spark, str(tmp_path / "n1" / "runs"), "latest").collect()) == [9, 10]
    inv = readers.file_inventory(spark, str(tmp_path / "n1" / "runs"), "n1")
    assert readers.latest_date_numeric(inv, ["node_id"]).first().height == 10
    (tmp_path / "int").write_text("42\n")
    assert readers.read_single_ints(spark, str(tmp_path / "int")).first().value == 42
    (tmp_path / "doc.json").write_text('{"a": 1}')
    assert readers.read_documents(spark, str(tmp_path / "doc.json")).filter("doc is not null").count() == 1
    assert readers.read_file_heads(spark, str(tmp_path / "doc.json"), 4).first()["state"] == "truncated"
    (tmp_path / "LOG").write_text("x\n---MARK---\none complete END\n---MARK---\nhalf")
    assert "one complete" in readers.read_marker_blocks(spark, str(tmp_path / "LOG"), "---MARK---", "END").first().block
    (tmp_path / "tcp").write_text("  sl  local_address rem_address   st\n   0: 0100007F:0FA1 00000000:0000 0A 0\n")
    sock = readers.read_socket_table(spark, str(tmp_path / "tcp"))
    r = sock.first()
    assert (r.local_port, r.state, r.bad) == (4001, "LISTEN", False) and telemetry_jobs.tcp_sockets(sock, [4001]).filter("n > 0").count() == 1
    (tmp_path / "tail").write_text('{"a":1}\n{"b":')
    assert not readers.stream_tail_status(spark, str(tmp_path / "tail")).first().valid
    big, rows = tmp_path / "big", [f"{i} é".ljust(i % 90, "x") for i in range(4000)]
    big.mkdir()
    (big / "whole").write_text("".join(f"{x}\n" for x in rows))
    (big / "torn").write_text("\n".join(rows))
    (big / "none").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits a file
    good, rejects = readers.drop_torn_tails(spark, str(big))
    got = {(r.file_path.split("/")[-1], r.line_no): r.line for r in good.collect()}
    assert got == {(f, i): x for f in ("whole", "torn") for i, x in enumerate(rows) if f == "whole" or i < 3999}
    assert [(r.line, r.reason) for r in rejects.collect()] == [(rows[-1], "torn_line")]
    heads = {r.path.split("/")[-1]: r for r in readers.read_file_heads(spark, str(big), 50).collect()}
    assert {f: r.state for f, r in heads.items()} == {"whole": "truncated", "torn": "truncated", "none": "empty"}
    assert heads["torn"].head == "\n".join(rows).encode()[:50].decode("utf-8", "replace") and heads["none"].head == ""
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    m = sinks.metric(spark.createDataFrame([("n1", dt.datetime(2026, 5, 25), "x", 1.0)], "node_id string, ts timestamp, label string, v double"), "m", "gauge", ["label"], F.col("v"))
    for _ in range(2):
        sinks.write_metrics(m, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 1
    rows = spark.createDataFrame([("192.0.2.1", "m", A), ("", "n", B)], "ip string, moniker string, address string")
    sinks.write_validator_csv(rows, str(tmp_path / "csv"))
    sinks.write_lines(rows, "ip", str(tmp_path / "txt"))
    sinks.write_jsonl(rows, str(tmp_path / "jsonl"))
    assert spark.read.text(str(tmp_path / "txt")).count() == 1 and spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["ip", "moniker", "address", "vp"]


@pytest.mark.parametrize("n", [2])
def test_streams_equal_batch(spark, tmp_path, n):
    from nodelytics.operators import folds
    from nodelytics.streaming import state

    rows = [("a", i, m, (3600 + i) * 1_000_000) for i, m in enumerate("xyxzwyxzz")]
    schema = "key string, seq long, member string, us long"
    src = tmp_path / "src"
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    state.run_available(state.ttl_set(stream, "key", "member", "us", "seq", 3, n), "ttl", str(tmp_path / "c1"))
    want = folds.ttl_set(spark.createDataFrame(rows, schema), ["key"], ["us", "seq"], "member", "us", 3, n)
    pick = lambda df: sorted((r.us, r.added, r.expired, r.dropped, r["size"]) for r in df.collect())
    assert pick(spark.table("ttl")) == pick(want)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    state.run_available(state.sticky_names(stream, "key", "member", "us", "seq", n), "sticky", str(tmp_path / "c2"))
    assert [r.label for r in spark.table("sticky").orderBy("seq").collect()] == [m if m in "xy" else "other" for m in "xyxzwyxzz"]
    stream = spark.readStream.schema(schema).parquet(str(src)).withColumn("ts", F.timestamp_micros("us"))
    state.run_available(state.dedupe(stream, ["member"], "ts", "1 hour"), "once", str(tmp_path / "c3"))
    assert spark.table("once").count() == 4
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    state.run_available(state.monotone(stream, "key", "seq", ["us"]), "mono", str(tmp_path / "c4"))
    assert spark.table("mono").filter("verdict = 'accepted'").count() == 9
    a = spark.readStream.schema(schema).parquet(str(src)).select("member", F.timestamp_micros("us").alias("q_ts"))
    b = spark.readStream.schema(schema).parquet(str(src)).select("member", F.timestamp_micros("us").alias("r_ts"))
    state.run_available(state.correlate(a, b, ["member"], "q_ts", "r_ts", "2 seconds"), "pairs", str(tmp_path / "c5"))
    times = [(m, u) for _, _, m, u in rows]
    assert spark.table("pairs").count() == sum(x == y and 0 <= v - u <= 2_000_000 for x, u in times for y, v in times)
