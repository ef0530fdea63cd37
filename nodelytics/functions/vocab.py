"""Closed vocabularies.  All lists here are fixed values of the node's formats."""

# fixed values: action types and their categories; types outside are "other"
ACTION_CATEGORIES = {
    "order": "trading",
    "twapOrder": "trading",
    "twapCancel": "trading",
    "cancel": "trading",
    "cancelByCloid": "trading",
    "batchModify": "trading",
    "modify": "trading",
    "scheduleCancel": "trading",
    "liquidate": "trading",
    "usdClassTransfer": "transfer",
    "usdSend": "transfer",
    "spotSend": "transfer",
    "sendAsset": "transfer",
    "agentSendAsset": "transfer",
    "sendToEvmWithData": "transfer",
    "vaultTransfer": "transfer",
    "vaultDistribute": "transfer",
    "subAccountTransfer": "transfer",
    "subAccountSpotTransfer": "transfer",
    "cDeposit": "transfer",
    "cWithdraw": "transfer",
    "withdraw3": "transfer",
    "spotUser": "transfer",
    "approveAgent": "settings",
    "approveBuilderFee": "settings",
    "setReferrer": "settings",
    "updateLeverage": "settings",
    "updateIsolatedMargin": "settings",
    "createSubAccount": "settings",
    "subAccountModify": "settings",
    "registerReferrer": "settings",
    "linkStakingUser": "settings",
    "setDisplayName": "settings",
    "createVault": "settings",
    "vaultModify": "settings",
    "topUpIsolatedOnlyMargin": "settings",
    "convertToMultiSigUser": "settings",
    "multiSig": "settings",
    "agentEnableDexAbstraction": "settings",
    "agentSetAbstraction": "settings",
    "userSetAbstraction": "settings",
    "userDexAbstraction": "settings",
    "authorizeAqav2Role": "settings",
    "stakingLinkDisableTradingUser": "settings",
    "userPortfolioMargin": "settings",
    "tokenDelegate": "governance",
    "voteAppHash": "governance",
    "VoteEthDepositAction": "governance",
    "VoteEthFinalizedWithdrawalAction": "governance",
    "VoteGlobalAction": "governance",
    "SetGlobalAction": "governance",
    "CSignerAction": "governance",
    "CValidatorAction": "governance",
    "ValidatorSignWithdrawalAction": "governance",
    "NetChildVaultPositionsAction": "governance",
    "validatorL1UpdateReferenceOracle": "governance",
    "validatorL1Vote": "governance",
    "validatorL1Stream": "governance",
    "voteL1Hash": "governance",
    "l1ValidatorVoteBridgeDeposit": "governance",
    "gossipPriorityBid": "governance",
    "claimRewards": "rewards",
    "reserveRequestWeight": "rewards",
    "evmRawTx": "evm",
    "evmUserModify": "evm",
    "evmUserSpotTransfer": "evm",
    "finalizeEvmContract": "evm",
    "perpDeploy": "deployment",
    "spotDeploy": "deployment",
    "activateOutcomeDeployer": "deployment",
    "deployerSendToEvmForFrozenUser": "deployment",
    "startFeeTrial": "deployment",
    "reassessFees": "deployment",
    "borrowLend": "markets",
    "userOutcome": "markets",
    "hip3LiquidatorTransfer": "markets",
    "noop": "system",
}
# fixed values: events of the pending-transaction log and their labels
MEMPOOL_EVENTS = {
    "add_tx": "add_tx",
    "verify_block": "verify_block",
    "committed": "committed",
    "dropping blocks": "dropping_blocks",
    "dropping txs": "dropping_txs",
    "handle_blocks_and_txs": "handle_blocks_and_txs",
    "register_block unknown tx hashes": "register_block_unknown_tx_hashes",
    "Size stats": "size_stats",
    "Pruned rpc request throttle": "pruned_rpc_request_throttle",
}
# fixed values: components of a size report
MEMPOOL_SIZES = ["committed_tx_hashes", "uncommitted_txs", "blocks", "rpc_requests"]
# fixed values: time in force of orders
TIME_IN_FORCE = ["Alo", "FrontendMarket", "Gtc", "Ioc"]
# fixed values: transaction types
TX_TYPES = ["Eip1559", "Legacy", "Eip2930"]
# fixed values: socket states
SOCKET_STATES = ["ESTABLISHED", "SYN_SENT", "SYN_RECV", "FIN_WAIT1", "FIN_WAIT2", "TIME_WAIT", "CLOSE", "CLOSE_WAIT", "LAST_ACK", "LISTEN", "CLOSING", "UNKNOWN"]
# fixed values: crash classes in order, with their needles; an explicit panic comes last
STDERR_CLASSES = [
    ("app_hash_mismatch", ["computed app hash", "does not match quorum"]),
    ("hardfork_upgrade", ["observed qc for newer hardfork"]),
    ("sync_overflow", ["too many blocks to request"]),
    ("config_error", ["is not in node_ips", "could not read", "configuration error"]),
    ("network", ["connection timeout", "upstream connect error", "invalid ip address"]),
    ("panic", ["panicked at", "panicked:"]),
]
# fixed values: error kinds of the pending-transaction log and their labels
MEMPOOL_ERRORS = {
    "MissingValidatorSetRound": "missing_validator_set_round",
    "TxInvalidBroadcasterNonce": "tx_invalid_broadcaster_nonce",
    "BadBlockRound": "bad_block_round",
    "TxUnexpectedBroadcaster": "tx_unexpected_broadcaster",
    "BlockAlreadyRegistered": "block_already_registered",
    "AddTxDuplicate": "add_tx_duplicate",
    "AddTxCommitted": "add_tx_committed",
    "AddTxNotSignedAction": "add_tx_not_signed_action",
}
# fixed values: tags of the connection log and their labels
GOSSIP_TAGS = {
    "verified gossip rpc": "verified_gossip_rpc",
    "handle_stream_connection": "handle_stream_connection",
    "performing checks on stream": "performing_checks_on_stream",
    "got tcp greeting": "got_tcp_greeting",
    "error checking connection": "error_checking_connection",
    "rejecting gossip stream because max peers reached": "rejecting_gossip_stream_max_peers_reached",
    "closing gossip stream because no quorum yet": "closing_gossip_stream_no_quorum_yet",
    "finished checks": "finished_checks",
    "sending abci_state": "sending_abci_state",
    "successfully sent abci_state": "successfully_sent_abci_state",
    "sending evm kvs": "sending_evm_kvs",
    "dropping connection after sending abci state": "dropping_connection_after_sending_abci_state",
    "marking node_ip as verified": "marking_node_ip_verified",
    "dropping connection": "dropping_connection",
    "closing gossip stream because peer is already connected": "closing_gossip_stream_peer_already_connected",
}
# fixed values: consensus buckets
ACCUMULATOR_BUCKETS = ["CommittedBlocks", "CommittedTxs", "CommittedTxBytes", "DroppedTxs", "RoundCatchUp", "RoundQc", "RoundTc", "RpcRequestsRegistered", "RpcRequestsSent"]
# fixed values: outcomes of a reachability probe
PROBE_OUTCOMES = ["success", "timeout", "refused", "unreachable"]
# fixed values: histogram bounds (milliseconds, counts, gwei, seconds)
BLOCK_TIME_MS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 120, 140, 160, 180, 200, 220, 240, 260, 280, 300, 350, 400, 450, 500, 600, 700, 800, 900, 1000, 1500, 2000]
APPLY_MS = [0.1, 0.2, 0.5, 1, 2, 3, 5, 7, 10, 15, 20, 30, 50, 75, 100, 150, 160, 170, 180, 190, 200, 210, 220, 230, 240, 250, 300, 400, 500, 750, 1000, 1500, 2000, 3000, 5000, 10000]
ACTIONS_PER_BLOCK = [0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000]
ORDERS_PER_BLOCK = [0, 1, 2, 5, 10, 20, 50, 100, 150, 200, 250, 300, 400, 500, 750, 1000, 1500, 2000, 3000, 5000, 7500, 10000]
OPERATIONS_PER_BLOCK = [0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 3000, 5000, 7500, 10000, 15000, 20000, 30000, 50000]
EVM_BLOCK_TIME_MS = [200, 400, 600, 800, 900, 1000, 1100, 1200, 1300, 1400, 1500, 1600, 1700, 1800, 1900, 2000, 2200, 2500, 2800, 3200]
EVM_TX_PER_BLOCK = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 20, 25, 30, 35, 40]
FEE_GWEI = [0.1, 0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90, 100, 125, 150, 175, 200, 250, 300, 400, 500, 600, 700, 800, 900, 1000, 1500, 2000, 5000]
CERTIFICATE_SIZE = [1, 3, 5, 7, 10, 13, 16, 19, 22, 25, 28, 31, 34, 37, 40, 43, 46, 49, 51]
ROUND_ADVANCE = [1, 2, 3, 4, 5, 10, 25, 50, 100]
MEMPOOL_ACTIONS = [1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]
RECEIPT_LAG_S = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1, 2, 5, 10, 30, 60, 180]
ACK_DELAY_S = [1e-4 * 2**i for i in range(18)]
SELF_LOOP_S = [1e-6 * 2**i for i in range(18)]
# fixed values: limits and horizons in seconds, ratios, counts
HEARTBEAT_HORIZON_S, RPC_TTL_S, RPC_OPEN = 300, 600, 4096
PARTICIPATION_BLOCKS, EWMA_ALPHA, SWITCH_RATIO = 100, 0.3, 1.2
TRAFFIC_TOP, ADMISSION_GAP_S, SET_CAPACITY, SET_TTL_S = 16, 90, 2048, 86_400
PAIR_TOLERANCE_S, CRITICAL_SKEW_S, LOCATION_CAP, VALIDATOR_ROWS = 5, 120, 32, 500
EMA_SENTINEL, EMA_EPS = 0.4, 1e-9
