"""Domain jobs over chain streams: blocks, actions, transactions, consensus, validators.

Every job takes lines ``(node_id, line, ...)`` or typed rows, and returns named tables; ``rejects``
holds whole records that failed, with stage and reason.  All state is kept per ``node_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json, vocab
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import folds, joins, topk, validation
from ..operators import windows as W
from ..operators.windows import micros

Tables = dict[str, DataFrame]


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that are evaluated once a row.

    As a generator's output they cannot be written out again in every later filter and column, as
    plain columns are: a record would be parsed anew for each use of each of its fields.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def records(lines: DataFrame) -> DataFrame:
    """JSON object records: column ``v``."""
    return once(lines, {"v": json.record(F.col("line"))})


def enveloped(lines: DataFrame) -> DataFrame:
    """``["<time>", payload]`` records: ``ts`` (null if it does not parse) and ``p``."""
    e = once(once(lines, {"_v": json.record(F.col("line"))}), {"_e": json.envelope(F.col("_v"))}).drop("_v")
    return once(e, {"ts": S.parse_ts(F.col("_e.ts")), "p": F.col("_e.payload"), "bad_record": F.col("_e").isNull()}).drop("_e")


def checked(rows: DataFrame, checks: Sequence[tuple[str, str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with ``(stage, reason, line)``."""
    good, bad = validation.split_rejects(validation.validate(rows, checks))
    return good, bad.select("node_id", "stage", "reason", "line")


def _envelope_checks() -> list[tuple[str, str, Column]]:
    return [("record", "bad_envelope", F.col("bad_record")), ("record", "bad_time", F.col("ts").isNull())]


def _items(v: Column, path: str) -> Column:
    return json.req(v, path, "array")


def _text(v: Column, path: str) -> Column:
    return json.req(v, path, "string")


def _int(v: Column, path: str) -> Column:
    return json.req(v, path, "int")


def _num(v: Column, path: str) -> Column:
    return json.req(v, path, "number")


# --- source health ---------------------------------------------------------------------------


def source_health(rows: DataFrame, source: Sequence[str], ts: str) -> DataFrame:
    """Per source over accepted and rejected rows: counts, last attempt, last valid record, and whether the newest was valid."""
    good = F.col("reject").isNull()
    made = rows.groupBy(*source).agg(F.count(F.lit(1)).alias("records"), F.sum((~good).cast("long")).alias("rejects"), F.max(ts).alias("last_attempt"), F.max(F.when(good, F.col(ts))).alias("last_valid"))
    age = (micros("last_attempt") - micros("last_valid")) / 1e6
    return made.withColumns({"schema_ok": F.coalesce((F.col("last_valid") == F.col("last_attempt")).cast("int"), F.lit(0)), "valid_age_s": age})


# --- blocks ----------------------------------------------------------------------------------


def core_blocks(lines: DataFrame) -> Tables:
    """Lines with ``state_type`` (fast, slow, legacy), in the order of ``seq`` if there is one: accepted blocks, their intervals, apply times and histograms."""
    v = F.col("v")
    rows = once(records(lines), {"height": _int(v, "$.height"), "block_time": S.parse_ts(_text(v, "$.block_time")), "wall_text": _text(v, "$.begin_block_wall_time"), "apply_s": _num(v, "$.apply_duration")})
    good, rejects = checked(rows, [("record", "bad_json", v.isNull()), ("block", "bad_height", F.col("height").isNull() | (F.col("height") < 0)), ("block", "bad_time", F.col("block_time").isNull()), ("block", "bad_duration", ~S.finite_nonneg(F.col("apply_s")))])
    good = good.select("node_id", "state_type", "height", "block_time", S.parse_ts(F.col("wall_text")).alias("wall_time"), (F.col("apply_s") * 1000).alias("apply_ms"), *[c for c in ("landed", "seq") if c in lines.columns], micros("block_time").alias("us"))
    arrival = ["seq"] if "seq" in lines.columns else ["us", "height"]
    kept = folds.monotone_filter(good, ["node_id", "state_type"], arrival, ["us", "height"])
    blocks = W.inter_arrival(kept, ["node_id", "state_type"], "block_time", "height")
    if "landed" in lines.columns:
        lag = (micros("landed") - micros("wall_time")) / 1e6
        blocks = blocks.withColumn("receipt_lag_s", F.when(lag >= 0, lag))
    return {
        "core_block": blocks, "rejects": rejects,
        "core_block_hist": A.explicit_histogram(blocks, "gap_ms", vocab.BLOCK_TIME_MS, ["node_id", "state_type"]),
        "core_apply_hist": A.explicit_histogram(blocks, "apply_ms", vocab.APPLY_MS, ["node_id", "state_type"]),
        "core_height": A.latest_per_key(blocks.filter("state_type <> 'slow'").select("node_id", "height", "block_time"), ["node_id"], ["block_time"]),
    }


def _actions(groups: Column) -> Column:
    """Type, inner type and operation lists of the signed actions of all bundles; a type that is no text is null."""
    action = lambda a: F.struct(
        _text(a, "$.action.type").alias("type"),
        _text(a, "$.action.payload.action.type").alias("inner"),
        *[F.size(_items(a, f"$.action.{name}")).alias(name) for name in ("orders", "cancels", "modifies")],
    )
    return F.transform(F.flatten(groups), action)


def _unlisted(a: Column) -> Column:
    """An action whose type needs a list that it does not have."""
    return ((a["type"] == "order") & a["orders"].isNull()) | (a["type"].isin("cancel", "cancelByCloid") & a["cancels"].isNull()) | ((a["type"] == "batchModify") & a["modifies"].isNull())


def _operations(a: Column) -> Column:
    """Operations of one action by the sizes of its lists."""
    sizes = F.when(a["type"] == "order", a["orders"]).when(a["type"].isin("cancel", "cancelByCloid"), a["cancels"]).when(a["type"] == "batchModify", a["modifies"])
    return F.coalesce(sizes, F.lit(1)).cast("long")


def replica_blocks(lines: DataFrame) -> Tables:
    """Block records with bundles of signed actions: per block and per action type; empty blocks are valid, empty bundles are not.

    A record is parsed once, and all sums of a block are taken over its own lists.
    """
    v = F.col("v")
    block = {
        "height": _int(v, "$.height"), "block_time": S.parse_ts(_text(v, "$.abci_block.time")), "round": _int(v, "$.abci_block.round"), "parent_round": _int(v, "$.abci_block.parent_round"), "proposer": _text(v, "$.abci_block.proposer"),
        "groups": F.transform(_items(v, "$.abci_block.signed_action_bundles"), lambda b: _items(b, "$[1].signed_actions")),
        "statuses": F.flatten(F.transform(_items(v, "$.resps.Full"), lambda g: F.transform(_items(g, "$[1]"), lambda r: _text(r, "$.res.status")))),
        "bad_json": v.isNull(),
    }
    rows = once(records(lines), block).drop("v")
    rows = once(rows, {"acts": _actions(F.col("groups"))})
    good, rejects = checked(rows, [
        ("record", "bad_json", F.col("bad_json")), ("record", "bad_height", F.col("height").isNull() | (F.col("height") <= 0)),
        ("block", "bad_time", F.col("block_time").isNull()), ("block", "bad_round", F.col("round").isNull() | (F.col("round") <= 0)), ("block", "no_proposer", F.col("proposer").isNull()),
        ("bundles", "no_list", F.col("groups").isNull()), ("bundle", "no_actions", F.exists("groups", lambda g: F.coalesce(F.size(g) == 0, F.lit(True)))),
        ("action", "no_type", F.exists("acts", lambda a: a["type"].isNull())), ("operation", "no_list", F.exists("acts", _unlisted)),
    ])
    good = once(good, {"acts": F.transform("acts", lambda a: F.struct(a["type"].alias("type"), a["inner"].alias("inner"), _operations(a).alias("operations")))})
    add = lambda pick: F.aggregate("acts", F.lit(0).cast("long"), lambda s, a: s + pick(a))
    blocks = good.select(
        "node_id", "height", "block_time", "round", "parent_round", "proposer", F.size("groups").alias("bundles"), F.size("acts").alias("actions"), add(lambda a: a["operations"]).alias("operations"),
        add(lambda a: F.when(a["type"].isin("order", "twapOrder"), a["operations"]).otherwise(0)).alias("orders"), (F.col("round") - F.col("parent_round")).alias("round_advance"),
    )
    acts = good.select("node_id", F.inline("acts"))
    names = list(vocab.ACTION_CATEGORIES)
    # raw types meet first, so the vocabulary is looked up once a type and not once an action
    action = acts.groupBy("node_id", "type", "inner").agg(F.count(F.lit(1)).alias("actions"), F.sum("operations").alias("operations"))
    action = action.groupBy("node_id", F.col("type").alias("action"), S.categorize(F.col("type"), vocab.ACTION_CATEGORIES).alias("category"), S.normalize_vocab(F.col("inner"), names).alias("inner")).agg(F.sum("actions").alias("actions"), F.sum("operations").alias("operations"))
    responses = A.response_stats(good, ["node_id", "height"], F.size("acts"), "statuses")
    return {
        "replica_block": blocks, "replica_action": action, "replica_response": responses, "rejects": rejects, "proposal": A.counter(blocks, ["node_id", "proposer"], name="blocks"),
        "replica_hist": A.explicit_histogram(blocks, "actions", vocab.ACTIONS_PER_BLOCK, ["node_id"]), "replica_order_hist": A.explicit_histogram(blocks, "orders", vocab.ORDERS_PER_BLOCK, ["node_id"]), "replica_operation_hist": A.explicit_histogram(blocks, "operations", vocab.OPERATIONS_PER_BLOCK, ["node_id"]),
    }


def proposals(lines: DataFrame) -> DataFrame:
    """Proposer counts without decoding the actions."""
    return lines.select("node_id", F.get_json_object("line", "$.abci_block.proposer").alias("proposer")).filter("proposer is not null").groupBy("node_id", "proposer").agg(F.count(F.lit(1)).alias("blocks"))


def _shape(none: Column, to: Column) -> Column:
    return F.when(none, "create").when(S.is_full_address(to), "message").otherwise("unknown")


def _recipient(t: Column) -> tuple[Column, Column]:
    """Whether a transaction body (``tag``, ``body``) names no recipient, and the recipient."""
    return F.is_variant_null(F.try_variant_get(t["body"], "$.to", "variant")), F.lower(_text(t["body"], "$.to"))


def _kind(t: Column) -> Column:
    """Type and shape of one transaction body."""
    none, to = _recipient(t)
    return F.struct(S.normalize_vocab(t["tag"], vocab.TX_TYPES).alias("type"), _shape(none, to).alias("shape"))


def _transaction(base: Column):
    """Type, shape, recipient and effective priority fee of one transaction body."""
    prices = ("maxPriorityFeePerGas", "maxFeePerGas", "gasPrice")

    def read(t: Column) -> Column:
        none, to = _recipient(t)
        return F.struct(t["tag"].alias("tag"), none.alias("none"), to.alias("to"), *[_text(t["body"], f"$.{name}").alias(name) for name in prices])

    def priced(x: Column) -> Column:
        fee = S.bound(F.struct(*[S.wide(x[n]).alias(n) for n in prices]), lambda w: A.priority_fee(x["tag"], *[w[n] for n in prices], base, S.wide_sub))
        return F.struct(S.normalize_vocab(x["tag"], vocab.TX_TYPES).alias("type"), _shape(x["none"], x["to"]).alias("shape"), x["to"].alias("recipient"), fee.alias("fee"))

    return lambda t: S.bound(read(t), priced)


def evm_blocks(lines: DataFrame) -> Tables:
    """Execution blocks with transactions and receipts: gas, fees (to 256 bits), transaction types and shapes, receipt outcomes.

    A record is parsed once; fees, receipts and calls of a block are sums over its own lists, so a block that is logged
    twice counts twice in every table, and nothing is joined back.  Each table reads of a record's lists only what it
    states: counts and outcomes read no fee, types and shapes no number.
    """
    p, b = F.col("p"), F.col("b")
    rows = once(enveloped(lines), {"b": json.single_variant(p, "$.block")["body"]})
    q = lambda name: S.quantity(_text(b, f"$.header.header.{name}"))
    rows = once(rows, {
        "number": q("number").cast("long"), "gas_limit": q("gasLimit"), "gas_used": q("gasUsed"), "block_time": F.timestamp_seconds(q("timestamp").cast("long")),
        "base_fee": _text(b, "$.header.header.baseFeePerGas"), "no_version": b.isNull(),
        "bodies": F.transform(_items(b, "$.body.transactions"), lambda t: json.single_variant(t, "$.transaction")),
        "receipts": _items(p, "$.receipts"), "system_txs": F.coalesce(F.size(_items(p, "$.system_txs")), F.lit(0)), "calls": _items(p, "$.read_precompile_calls"),
    }).drop("p", "b")
    good, rejects = checked(rows, [
        *_envelope_checks(), ("block", "no_version", F.col("no_version")), ("header", "bad_number", F.col("number").isNull()),
        ("header", "bad_gas", F.col("gas_used").isNull() | F.col("gas_limit").isNull() | (F.col("gas_used") > F.col("gas_limit"))), ("header", "bad_time", F.col("block_time").isNull()),
        ("body", "no_transactions", F.col("bodies").isNull()), ("transaction", "bad_variant", F.exists("bodies", lambda t: t.isNull())), ("receipts", "no_list", F.col("receipts").isNull()),
    ])
    good = good.withColumns({"n_txs": F.size("bodies"), "n_receipts": F.size("receipts")})
    mismatch = F.col("n_txs") != F.col("n_receipts")
    success = F.transform("receipts", lambda r: json.req(r, "$.success", "bool"))
    number_of = lambda of, p: F.size(F.filter(of, p))
    of_all = lambda s: {"success": number_of(s, lambda x: x), "failed": number_of(s, lambda x: ~x), "unknown": number_of(s, lambda x: x.isNull())}
    ended = of_all(F.col("ended"))
    outcomes = once(good.select("node_id", "number", mismatch.alias("mismatch"), "receipts"), {"ended": success})
    outcomes = outcomes.groupBy("node_id").agg(*[F.sum(c).alias(n) for n, c in ended.items()], F.sum(F.col("mismatch").cast("long")).alias("mismatches"), F.max(F.when(F.col("mismatch"), F.col("number"))).alias("last_mismatch"))
    mismatches = good.filter(mismatch).groupBy("node_id").agg(F.count(F.lit(1)).alias("mismatches"), F.max("number").alias("last_mismatch"))
    kinds = once(good.select("node_id", "bodies"), {"kinds": F.transform("bodies", _kind)}).select("node_id", F.inline("kinds"))
    effective = F.transform("receipts", lambda r: S.wide(F.coalesce(_text(r, "$.effectiveGasPrice"), _text(r, "$.effective_gas_price"))))
    priced = once(good, {"base_fee": S.wide(F.col("base_fee")), "effective": effective})
    priced = once(priced, {"txs": F.transform("bodies", _transaction(F.coalesce("base_fee", S.wide_zero())))}).drop("bodies")
    best = A.block_priority_fee(F.transform("txs", lambda t: t["fee"]), F.col("effective"), F.coalesce("base_fee", S.wide_zero()), S.wide_sub)
    priced = once(priced, {"best": best})
    some = F.col("n_txs") + F.col("n_receipts") > 0
    calls = A.nested_outcomes(F.transform("calls", lambda c: _items(c, "$[1]")), lambda c: F.try_variant_get(c, "$[1].Ok", "variant").isNotNull())
    blocks = priced.select(
        "node_id", "number", "block_time", S.gas_ratio(F.col("gas_used"), F.col("gas_limit")).alias("gas_ratio"), S.wide_gwei(F.col("base_fee")).alias("base_fee_gwei"),
        F.col("n_txs").alias("txs"), F.col("n_receipts").alias("receipts"), mismatch.alias("mismatch"), "system_txs", calls.alias("calls"),
        F.when(some, S.wide_gwei(F.coalesce("best", S.wide_zero()))).alias("max_priority_gwei"), F.when(some, F.col("best").isNotNull()).alias("has_fee"), *[c.alias(n) for n, c in of_all(success).items()],
    )
    timed = W.advancing_interval(blocks, ["node_id"], ["number"], "block_time")
    txs = priced.select("node_id", "number", F.inline("txs")).withColumn("fee_gwei", S.wide_gwei(F.col("fee")))
    return {
        "evm_block": timed, "evm_tx": txs, "rejects": rejects, "evm_tx_types": A.counter(kinds, ["node_id", "type", "shape"]), "evm_receipt": outcomes, "evm_mismatch": mismatches.select("node_id", "mismatches", "last_mismatch"),
        "evm_time_hist": A.explicit_histogram(timed, "gap_ms", vocab.EVM_BLOCK_TIME_MS, ["node_id"]), "evm_tx_hist": A.explicit_histogram(good, "n_txs", vocab.EVM_TX_PER_BLOCK, ["node_id"]),
        "evm_fee_hist": A.explicit_histogram(blocks.filter("has_fee"), "max_priority_gwei", vocab.FEE_GWEI, ["node_id"]),
        "evm_recipients": A.counter(W.sticky_topn(txs.filter("recipient is not null"), ["node_id"], "recipient", ["number"], 20), ["node_id", "label"]),
    }


# --- consensus -------------------------------------------------------------------------------


def _consensus(lines: DataFrame) -> DataFrame:
    rows = once(enveloped(lines), {"tag": _text(F.col("p"), "$[0]")})
    inner = F.try_variant_get(F.col("p"), "$[1]", "variant")
    message = F.coalesce(F.try_variant_get(inner, "$.msg", "variant"), inner)
    return once(rows, {"body": inner, "source": S.normalize_address(_text(inner, "$.source")), "m": F.when(F.col("tag").isin("in", "out"), json.single_variant(message))})


def consensus_events(lines: DataFrame) -> Tables:
    """Blocks, votes, certificates, rounds and status from the consensus log; directions count before copies go."""
    rows = _consensus(lines)
    body, m = F.col("body"), F.col("m")
    good, rejects = checked(rows, [*_envelope_checks(), ("event", "no_tag", F.col("tag").isNull()), ("message", "bad_variant", F.col("tag").isin("in", "out") & m.isNull())])
    mb = m["body"]
    blocks = good.filter(m["tag"] == "Block").select("node_id", "ts", F.col("tag").alias("direction"), _int(mb, "$.round").alias("round"), S.wire_key(_text(mb, "$.proposer")).alias("proposer"), _text(mb, "$.hash").alias("hash"), _int(mb, "$.qc.round").alias("qc_round"), _text(mb, "$.qc.block_hash").alias("qc_hash"), F.transform(_items(mb, "$.qc.signers"), lambda s: S.wire_key(F.try_variant_get(s, "$", "string"))).alias("signers"), F.transform(_items(mb, "$.tc.timeouts"), lambda s: S.wire_key(_text(s, "$.validator"))).alias("timeouts"))
    key = F.coalesce(F.concat(F.lit("hash:"), "hash"), F.concat_ws("|", "round", "proposer", "qc_round", "qc_hash"))
    directions = A.counter(blocks, ["node_id", "direction"])
    unique = A.latest_per_key(blocks.withColumn("key", key).withColumn("neg", -micros("ts")), ["node_id", "key"], ["neg"]).drop("neg")
    certified = unique.filter("qc_round > 0 and qc_hash is not null").withColumn("signers", F.coalesce("signers", F.array().cast("array<string>")))
    votes = good.filter(m["tag"] == "Vote").select("node_id", "ts", "source", F.coalesce(F.try_variant_get(mb, "$.vote", "variant"), mb).alias("x"))
    x = F.col("x")
    votes = votes.select("node_id", "ts", _int(x, "$.round").alias("round"), S.wire_key(F.coalesce(_text(x, "$.validator"), _text(x, "$.signer_id"), F.col("source"))).alias("validator")).filter("round > 0 and validator is not null")
    advance = good.filter("tag = 'round advance'").select("node_id", "ts", _int(body, "$.prev_round").alias("prev_round"), _int(body, "$.round").alias("round"), F.when(_text(body, "$.reason") == "qc", "qc").when(F.try_variant_get(body, "$.reason.Tc", "variant").isNotNull(), "tc").otherwise("other").alias("reason")).filter("round >= prev_round")
    status = good.filter("tag = 'status'").select("node_id", "ts", *[_int(body, f"$.{c}").alias(c) for c in ("round", "last_vote_round", "last_commit_round", "qc_round")])
    status = W.lags(status, "round", ["last_vote_round", "last_commit_round", "qc_round"])
    execution = good.filter("tag = 'execution state'").select("node_id", "ts", _int(body, "$.round").alias("execution_round"))
    reference = status.select("node_id", "ts", "round").unionByName(advance.select("node_id", "ts", "round")).unionByName(unique.select("node_id", "ts", "round")).groupBy("node_id", "ts").agg(F.max("round").alias("round"))
    execution = joins.asof(execution, reference, ["node_id"], "ts", "ts", "round", "consensus_round").withColumn("execution_lag", S.nonneg_diff(F.col("consensus_round"), F.col("execution_round")))
    sizes = certified.withColumn("qc_size", F.size("signers"))
    tcs = unique.filter("timeouts is not null").select("node_id", "key", F.size("timeouts").alias("tc_size"), "timeouts")
    rate = A.participation_rate(_within_hour(certified), ["node_id"], ["ts", "round"], "signers", vocab.PARTICIPATION_BLOCKS)
    return {
        "consensus_block": unique, "directions": directions, "consensus_vote": A.latest_per_key(votes, ["node_id", "validator"], ["ts", "round"]), "qc_signer": rate, "rejects": rejects,
        "tc_vote": A.counter(tcs.select("node_id", F.explode("timeouts").alias("validator")), ["node_id", "validator"]), "round_state": status, "round_advance": advance, "execution": execution,
        "round_step": W.positive_step(unique, ["node_id"], ["ts", "round"], "round"), "qc_hist": A.explicit_histogram(sizes, "qc_size", vocab.CERTIFICATE_SIZE, ["node_id"]), "tc_hist": A.explicit_histogram(tcs, "tc_size", vocab.CERTIFICATE_SIZE, ["node_id"]),
        "advance_hist": A.explicit_histogram(advance.withColumn("step", F.col("round") - F.col("prev_round")), "step", vocab.ROUND_ADVANCE, ["node_id", "reason"]),
    }


def _within_hour(df: DataFrame) -> DataFrame:
    newest = df.groupBy("node_id").agg(F.max("ts").alias("_newest"))
    return df.join(newest, "node_id").filter(micros("_newest") - micros("ts") <= 3_600_000_000).drop("_newest")


def heartbeat_join(lines: DataFrame, as_of: Column) -> Tables:
    """Heartbeats with their acknowledgements within five minutes; outcomes of every one."""
    rows = _consensus(lines)
    mb = F.col("m.body")
    keys = [S.wire_key(_text(mb, "$.validator")).alias("validator"), F.try_variant_get(mb, "$.random_id", "decimal(20,0)").alias("random_id"), F.try_variant_get(mb, "$.round", "decimal(20,0)").alias("round")]
    sent = rows.filter("tag = 'out' and m.tag = 'Heartbeat'").select("node_id", F.col("ts").alias("sent_ts"), *keys)
    acks = rows.filter("tag = 'in' and m.tag = 'HeartbeatAck'").select("node_id", F.col("ts").alias("ack_ts"), S.wire_key(F.col("source")).alias("src"), F.xxhash64("line").alias("ack_id"), *keys)
    on = ["node_id", "validator", "random_id", "round"]
    outcomes = joins.reply_outcomes(sent, acks, on, ["node_id", "random_id"], "src", "sent_ts", "ack_ts", "ack_id", vocab.HEARTBEAT_HORIZON_S)
    outcomes = outcomes.withColumn("kind", F.when(F.col("src").isNull(), "unknown").when(F.col("src") == F.col("validator"), "self").otherwise("peer"))
    latest = sent.groupBy(*on).agg(F.max("sent_ts").alias("sent_ts"))
    delays = outcomes.filter("outcome = 'matched'").join(latest, on).withColumn("delay_s", (micros("ack_ts") - micros("sent_ts")) / 1e6)
    beat, ack = F.expr("tag = 'out' and m.tag = 'Heartbeat'"), F.expr("tag = 'in' and m.tag = 'HeartbeatAck'")
    both = rows.filter(beat | ack).select("node_id", "ts", (F.col("tag") == "in").alias("reply"), *keys)  # parsed once
    expired = joins.latest_unanswered(both, on, "reply", "ts", vocab.HEARTBEAT_HORIZON_S, as_of)
    return {
        "heartbeat_ack": outcomes, "heartbeat_delay": delays, "heartbeat_expired": expired, "outcomes": A.counter(outcomes, ["node_id", "kind", "outcome"]),
        "peer_hist": A.explicit_histogram(delays.filter("kind = 'peer'"), "delay_s", vocab.ACK_DELAY_S, ["node_id"]), "self_hist": A.explicit_histogram(delays.filter("kind = 'self'"), "delay_s", vocab.SELF_LOOP_S, ["node_id"]),
    }


def without_alias_conflicts(good: DataFrame, rejects: DataFrame, stage: str, addresses: Column) -> tuple[DataFrame, DataFrame]:
    """Records of which two spellings may be one address become rejects; ``good`` has ``node_id``, ``ts`` and ``line``."""
    good = good.withColumn("_record", F.xxhash64("line"))
    key = ["node_id", "ts", "_record"]
    spelled = good.select(*key, F.explode(addresses).alias("address")).distinct()
    bad = joins.alias_conflicts(spelled, key, "address").select(*key).distinct()
    found = good.join(bad, key, "left_semi").select("node_id", F.lit(stage).alias("stage"), F.lit("alias_conflict").alias("reason"), "line")
    return good.join(bad, key, "left_anti").drop("_record"), rejects.unionByName(found)


def consensus_status(lines: DataFrame, most: int | None = vocab.VALIDATOR_ROWS) -> Tables:
    """The newest complete status per node: heartbeats, the disconnected relation, the missing set; a record of more than ``most`` heartbeats is rejected."""
    p = F.col("p")
    rows = once(enveloped(lines), {"round": _int(p, "$.round"), "statuses": _items(p, "$.heartbeat_statuses"), "pairs": _items(p, "$.disconnected_validators"), "missing": json.text_array(p, "$.validators_missing_heartbeat")})
    present = lambda name: F.try_variant_get(p, f"$.{name}", "variant").isNotNull()
    names = F.transform("statuses", lambda s: S.wire_key(_text(s, "$[0]")))
    spelled = F.transform("statuses", lambda s: F.lower(F.trim(_text(s, "$[0]"))))
    good, rejects = checked(rows, [*_envelope_checks(), ("status", "bad_round", F.col("round").isNull()), ("heartbeat", "bad_list", present("heartbeat_statuses") & F.col("statuses").isNull()), ("heartbeat", "too_many", F.lit(False) if most is None else F.size("statuses") > most), ("heartbeat", "bad_address", F.exists(names, lambda n: n.isNull())), ("heartbeat", "duplicate", F.size(spelled) != F.size(F.array_distinct(spelled))), ("disconnected", "bad_list", present("disconnected_validators") & F.col("pairs").isNull()), ("missing", "bad_list", present("validators_missing_heartbeat") & F.col("missing").isNull())])
    good, rejects = without_alias_conflicts(good, rejects, "heartbeat", spelled)
    now = A.latest_per_key(good.select("node_id", "ts", "round", "statuses", "pairs", "missing"), ["node_id"], ["ts", "round"])
    s = F.col("s")
    heartbeats = now.select("node_id", "ts", F.explode("statuses").alias("s")).select("node_id", "ts", S.wire_key(_text(s, "$[0]")).alias("validator"), _num(s, "$[1].since_last_success").alias("since_success_s"), json.presence(s, "$[1].last_ack_duration").alias("ack_presence"), _num(s, "$[1].last_ack_duration").alias("ack_s"))
    relation = now.select("node_id", "ts", F.explode("pairs").alias("s")).select("node_id", "ts", S.wire_key(_text(s, "$[0]")).alias("reporter"), F.explode(_items(s, "$[1]")).alias("d"))
    relation = relation.select("node_id", "ts", "reporter", S.wire_key(_text(F.col("d"), "$[0]")).alias("subject"), _int(F.col("d"), "$[1]").alias("since_round"))
    missing = now.select("node_id", "ts", F.explode("missing").alias("v")).select("node_id", "ts", S.wire_key(F.col("v")).alias("validator"))
    return {"status_heartbeat": heartbeats, "status_disconnect": relation, "status_missing": missing, "rejects": rejects}


def status_summary(tables: Tables, eligible: DataFrame) -> DataFrame:
    """Missing heartbeats and distinct disconnected subjects inside the eligible set ``(validator)``."""
    a = joins.count_semi(tables["status_missing"], eligible, ["validator"], ["node_id"]).withColumnRenamed("n", "missing")
    b = joins.count_semi(tables["status_disconnect"].withColumn("validator", F.col("subject")), eligible, ["validator"], ["node_id"]).withColumnRenamed("n", "disconnected")
    return a.join(b, "node_id", "full").na.fill(0)


def validator_status(lines: DataFrame) -> Tables:
    """Stake rows in two shapes, the jailed set and the home validator of the newest complete record; no address comes twice in a record, in any spelling."""
    p = F.col("p")
    stakes = F.coalesce(_items(p, "$.current_stakes.validator_to_stake"), _items(p, "$.current_stakes"))
    rows = once(enveloped(lines), {"home": S.wire_key(_text(p, "$.home_validator")), "stakes": stakes, "jailed": json.text_array(p, "$.current_jailed_validators")})
    rows = once(rows, {"addresses": F.transform("stakes", lambda s: F.lower(F.trim(_text(s, "$[0]")))), "numeric": F.transform("stakes", lambda s: _num(s, "$[1]")), "paired": F.transform("stakes", lambda s: _text(s, "$[1]"))})
    some = lambda c: F.exists(c, lambda x: x.isNotNull())
    good, rejects = checked(rows, [
        *_envelope_checks(), ("stakes", "no_list", F.col("stakes").isNull()), ("stakes", "mixed_rows", some("numeric") & some("paired")),
        ("stakes", "bad_row", F.exists(F.arrays_zip("numeric", "paired"), lambda s: s["numeric"].isNull() & s["paired"].isNull())),
        ("stakes", "bad_address", F.exists("addresses", lambda a: a.isNull())), ("stakes", "duplicate", F.size("addresses") != F.size(F.array_distinct("addresses"))),
    ])
    good, rejects = without_alias_conflicts(good, rejects, "stakes", F.col("addresses"))
    now = A.latest_per_key(good.select("node_id", "ts", "home", "stakes"), ["node_id"], ["ts"])
    jailed = A.latest_per_key(good.filter("jailed is not null").select("node_id", "ts", "jailed"), ["node_id"], ["ts"])
    s = F.col("s")
    each = now.select("node_id", "ts", "home", F.explode("stakes").alias("s")).select("node_id", "ts", "home", S.wire_key(_text(s, "$[0]")).alias("first"), _num(s, "$[1]").alias("stake"), S.wire_key(_text(s, "$[1]")).alias("signer"))
    return {
        "status_stake": each.filter("stake is not null").select("node_id", "ts", F.col("first").alias("signer"), "stake"), "signer_map": each.filter("signer is not null").select("node_id", "ts", F.col("first").alias("validator"), "signer"),
        "status_jailed": jailed.select("node_id", "ts", F.explode("jailed").alias("validator")), "home": now.select("node_id", "ts", "home"), "rejects": rejects,
    }


# --- validators ------------------------------------------------------------------------------


def validator_latency(lines: DataFrame) -> Tables:
    """Lines with ``validator``: newest sample and the greatest of each ten seconds."""
    v = F.col("v")
    rows = once(records(lines), {"ts": S.parse_ts(_text(v, "$.time")), "round": _int(v, "$.round"), "latency": _num(v, "$.latency")})
    good, rejects = checked(rows, [("record", "bad_json", v.isNull()), ("record", "bad_time", F.col("ts").isNull()), ("record", "bad_round", F.col("round").isNull()), ("record", "bad_latency", ~S.finite_nonneg(F.col("latency")))])
    rows = good.select("node_id", "validator", "ts", "round", "latency")
    return {"validator_latency": A.latest_per_key(rows, ["node_id", "validator"], ["ts", "round"]), "latency_peak": A.poll_peak(rows, ["node_id", "validator"], "ts", "latency", "10 seconds"), "rejects": rejects}


def validator_ema(lines: DataFrame) -> Tables:
    """Snapshots ``[[validator, value]...]``: their state, and the measured rows of the newest valid one."""
    p = F.col("p")
    rows = once(enveloped(lines), {"pairs": _items(p, "$")})
    good, rejects = checked(rows, [*_envelope_checks(), ("snapshot", "no_list", F.col("pairs").isNull()), ("snapshot", "bad_row", F.exists("pairs", lambda x: _text(x, "$[0]").isNull() | _num(x, "$[1]").isNull())), ("snapshot", "duplicate", F.size(F.array_distinct(F.transform("pairs", lambda x: _text(x, "$[0]")))) != F.size("pairs"))])
    each = good.select("node_id", "ts", F.explode("pairs").alias("x")).select("node_id", "ts", S.wire_key(_text(F.col("x"), "$[0]")).alias("validator"), _num(F.col("x"), "$[1]").alias("value"))
    state = validation.classify_snapshot(each, ["node_id", "ts"], "value", vocab.EMA_SENTINEL, vocab.EMA_EPS)
    newest = A.latest_per_key(state.filter("state <> 'invalid'"), ["node_id"], ["ts"])
    measured = each.filter(F.abs(F.col("value") - vocab.EMA_SENTINEL) > vocab.EMA_EPS).join(newest.filter("state = 'measured'").select("node_id", "ts"), ["node_id", "ts"], "left_semi")
    return {"validator_ema": measured, "ema_state": state, "rejects": rejects}


def accumulators(lines: DataFrame, buckets: Sequence[str]) -> Tables:
    """Lines with ``bucket``: sums of positive deltas, refused where not finite."""
    v = F.col("v")
    rows = once(validation.allow(records(lines), "bucket", buckets), {"ts": S.parse_ts(_text(v, "$.time")), "delta": _num(v, "$.delta")})
    good, rejects = checked(rows, [("record", "bad_json", v.isNull()), ("record", "bad_time", F.col("ts").isNull()), ("record", "bad_delta", F.col("delta").isNull() | F.isnan("delta"))])
    total = good.groupBy("node_id", "bucket").agg(A.safe_sum(F.when(F.col("delta") > 0, F.col("delta"))).alias("total"), F.max("ts").alias("last"))
    return {"accumulator": total, "rejects": rejects}


def validator_summaries(documents: DataFrame) -> Tables:
    """Response dumps ``(node_id, generation, doc)``: validators of complete generations, periods, and stake totals."""
    items = documents.select("node_id", "generation", F.posexplode(_items(F.col("doc"), "$")).alias("n", "r"))
    r = F.col("r")
    rows = items.select("node_id", "generation", S.normalize_address(_text(r, "$.validator")).alias("validator"), S.normalize_address(_text(r, "$.signer")).alias("signer"), S.name_or_unknown(_text(r, "$.name")).alias("name"), _int(r, "$.nRecentBlocks").alias("recent_blocks"), _num(r, "$.stake").alias("stake"), json.req(r, "$.isJailed", "bool").alias("jailed"), json.req(r, "$.isActive", "bool").alias("active"), F.timestamp_millis(F.nullif(_int(r, "$.unjailableAfter"), F.lit(0))).alias("unjailable_after"), _text(r, "$.commission").try_cast("double").alias("commission"), _items(r, "$.stats").alias("stats"))
    bad = F.col("validator").isNull() | F.col("signer").isNull() | F.col("jailed").isNull() | F.col("active").isNull() | ~S.finite_nonneg(F.col("stake"))
    good = validation.reject_generation(rows, ["node_id", "generation"], bad)
    good = validation.unique_within(validation.unique_within(good, ["node_id", "generation"], ["validator"]), ["node_id", "generation"], ["signer"])
    newest = good.groupBy("node_id").agg(F.max("generation").alias("generation"))
    now = good.join(newest, ["node_id", "generation"], "left_semi")
    s = F.col("s")
    periods = now.select("node_id", "generation", "validator", F.explode("stats").alias("s")).select("node_id", "generation", "validator", _text(s, "$[0]").alias("period"), _text(s, "$[1].uptimeFraction").try_cast("double").alias("uptime"), _text(s, "$[1].predictedApr").try_cast("double").alias("apr"))
    totals = A.conditional_totals(now, F.col("stake"), {"total": F.lit(True), "active": F.col("active"), "inactive": ~F.col("active"), "jailed": F.col("jailed"), "not_jailed": ~F.col("jailed"), "eligible": F.col("active") & ~F.col("jailed")}, ["node_id", "generation"])
    return {"validator": now.drop("stats"), "validator_period": periods.filter(F.col("period").isin("day", "week", "month")), "stake_totals": totals}


def validator_profiles(profiles: DataFrame, registry: DataFrame) -> Tables:
    """Decoded profile rows ``(node_id, day, height, address, moniker, ip, legacy)``: each node's newest set, and one representative height a day."""
    usable = profiles.withColumn("ip", S.canonical_ip(F.col("ip"))).filter("moniker <> '' and ip is not null")
    newest = usable.groupBy("node_id").agg(F.max(F.struct("day", "height")).alias("x")).select("node_id", "x.*")
    now = usable.join(newest, ["node_id", "day", "height"], "left_semi")
    resolved = joins.expand_truncated(now, "address", registry, "validator", S.truncate_address(F.col("validator")))
    counts = usable.groupBy("node_id", "day", "height").agg(F.count(F.lit(1)).alias("count"), F.bool_or("legacy").alias("legacy"))
    daily = counts.groupBy("node_id", "day").agg(F.max(F.struct("height", "count", "legacy")).alias("x")).select("node_id", "day", "x.*")
    return {"validator_profile": resolved.withColumn("address", F.coalesce("full", "address")).drop("full"), "validator_daily": daily}


def probe_targets(validators: DataFrame, profiles: DataFrame, as_of: Column, limit: int, max_age_s: int = 7200) -> DataFrame:
    """Active, unjailed validators with a fresh address, greatest stake first."""
    eligible = validators.filter("active and not jailed").select(F.col("validator").alias("address"), "stake")
    return joins.select_targets(eligible, profiles, "address", S.fresh(F.col("profile_ts"), as_of, max_age_s), [F.desc("stake"), F.col("address")], limit)


def probe_outcomes(results: DataFrame, as_of: Column) -> Tables:
    """Recorded probes ``(node_id, address, ts, outcome, rtt_s)``: attempts by outcome, and the age of the last success."""
    named = results.withColumn("outcome", S.normalize_vocab(F.col("outcome"), vocab.PROBE_OUTCOMES))
    last = named.filter("outcome = 'success'").groupBy("node_id", "address").agg(F.max("ts").alias("last"), F.max_by("rtt_s", "ts").alias("rtt_s"))
    return {"probe_result": A.counter(named, ["node_id", "address", "outcome"]), "probe_age": last.withColumn("age_s", S.nonneg_age(F.col("last"), as_of))}


def dominant_inbound(endpoints: DataFrame) -> DataFrame:
    """Endpoint rows ``(node_id, ts, ip, value)`` of one direction: the dominant one by decayed means, anew after a gap."""
    index = W.snapshot_index(endpoints, ["node_id"], "ts", vocab.ADMISSION_GAP_S * 1_000_000)
    rows = endpoints.groupBy("node_id", "ts", "ip").agg(F.sum("value").alias("value")).join(index, ["node_id", "ts"])
    made = folds.ewma_dominant(rows, ["node_id", "epoch"], "idx", "ip", "value", vocab.EWMA_ALPHA, vocab.SWITCH_RATIO)
    return made.join(index, ["node_id", "epoch", "idx"])


def ranked_inbound(endpoints: DataFrame) -> DataFrame:
    return topk.rank_with_ties(endpoints, ["node_id", "ts"], "value", "ip")
