"""Which query shows which command; commands without query semantics have none, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keyfold.plans.fixtures import Tables
from keyfold.plans.registry import query

# Command names, with the queries that express them.
COMMANDS: dict[str, str] = {
    # strings
    "GET": "str_get", "SET": "str_set_upsert str_set_xx str_setex log_fold_values", "SETNX": "str_setnx log_fold_values", "SETEX": "str_setex", "PSETEX": "str_setex",
    "GETSET": "str_getset", "MGET": "str_mget", "MSET": "str_set_upsert", "INCR": "str_incr log_fold_counters", "INCRBY": "str_incrby_sum", "DECR": "str_decr",
    "DECRBY": "str_decr str_incrby_sum", "APPEND": "str_append log_fold_values", "STRLEN": "str_strlen", "GETRANGE": "str_getrange", "SETRANGE": "str_setrange",
    "GETBIT": "bit_getbit", "SETBIT": "bit_setbit", "BITCOUNT": "bit_bitcount",
    # lists
    "LPUSH": "list_push", "RPUSH": "list_rpush", "LPOP": "list_lpop list_lpop_left", "RPOP": "list_rpop list_rpop_taken", "LLEN": "list_llen", "LRANGE": "list_lrange", "LINDEX": "list_lindex",
    "LSET": "list_lset", "LTRIM": "list_ltrim", "LREM": "list_lrem_head list_lrem_tail list_lrem_all", "BLPOP": "list_blpop_priority streaming_blocking_queue", "BRPOP": "list_brpop_priority",
    # sets
    "SADD": "set_add set_added", "SREM": "set_rem", "SMEMBERS": "set_members", "SISMEMBER": "set_ismember", "SCARD": "set_card", "SUNION": "set_union set_operations_by_db",
    "SINTER": "set_inter set_inter_n set_operations_by_db", "SDIFF": "set_diff set_operations_by_db", "SRANDMEMBER": "set_srandmember", "SPOP": "set_spop",
    # hashes
    "HSET": "hash_set hash_set_added", "HMSET": "hash_set", "HGET": "hash_get", "HMGET": "hash_mget", "HGETALL": "hash_getall", "HDEL": "hash_del", "HLEN": "hash_len",
    "HEXISTS": "hash_exists", "HKEYS": "hash_keys", "HVALS": "hash_vals", "HINCRBY": "hash_incrby log_fold_hash_counters",
    # sorted sets
    "ZADD": "zset_add", "ZREM": "zset_rem", "ZSCORE": "zset_score", "ZCARD": "zset_card", "ZRANK": "zset_rank", "ZREVRANK": "zset_revrank", "ZRANGE": "zset_range zset_range_tail",
    "ZREVRANGE": "zset_revrange", "ZRANGEBYSCORE": "zset_rangebyscore", "ZREVRANGEBYSCORE": "zset_revrangebyscore", "ZCOUNT": "zset_count", "ZINCRBY": "zset_incrby",
    "ZPOPMIN": "zset_popmin zset_popmin_left", "ZPOPMAX": "zset_popmax zset_popmax_taken", "ZREMRANGEBYRANK": "zset_remrangebyrank", "ZREMRANGEBYSCORE": "zset_remrangebyscore", "ZREMRANGEBYLEX": "zset_remrangebylex",
    # keys
    "DEL": "key_del", "EXISTS": "key_exists", "TYPE": "key_type", "EXPIRE": "key_expire", "PEXPIRE": "key_expire", "TTL": "key_ttl", "PTTL": "key_pttl", "PERSIST": "key_persist",
    "RENAME": "key_rename", "RENAMENX": "key_renamenx", "RANDOMKEY": "key_random", "KEYS": "key_glob key_glob_class", "SCAN": "scan_page", "HSCAN": "hscan_page", "SSCAN": "sscan_page",
    "ZSCAN": "zscan_page", "DBSIZE": "key_dbsize", "SELECT": "key_select", "FLUSHDB": "key_flushdb", "FLUSHALL": "key_flushall",
    # streams and groups
    "XADD": "stream_add_ids stream_monotonic_reject", "XLEN": "stream_len", "XRANGE": "stream_range", "XREVRANGE": "stream_revrange", "XREAD": "stream_read_offsets",
    "XTRIM": "stream_trim_maxlen stream_trim_minid", "XDEL": "stream_del", "XINFO": "stream_info group_info group_consumers_info", "XGROUP": "group_create group_setid group_destroy group_createconsumer group_delconsumer",
    "XREADGROUP": "group_deliver group_history group_cursor_after_read streaming_group_delivery", "XACK": "group_ack", "XPENDING": "group_pending_summary group_pending_detail",
    "XCLAIM": "group_claim_idle", "XAUTOCLAIM": "group_autoclaim",
    # messages, transactions, procedures
    "PUBLISH": "pubsub_publish_count pubsub_route streaming_router", "SUBSCRIBE": "pubsub_sub_count pubsub_live", "UNSUBSCRIBE": "pubsub_live", "PSUBSCRIBE": "pubsub_pattern_only", "PUNSUBSCRIBE": "pubsub_live",
    "MULTI": "txn_sessionize", "EXEC": "txn_watch_abort txn_exec_results", "DISCARD": "txn_sessionize", "WATCH": "txn_watched", "UNWATCH": "txn_watched",
    "EVAL": "proc_compare_and_delete proc_rate_limit", "EVALSHA": "proc_by_sha", "SCRIPT": "proc_script",
    # persistence and replication
    "SAVE": "snapshot_roundtrip", "BGSAVE": "bgsave_rules", "LASTSAVE": "snapshot_lastsave", "BGREWRITEAOF": "log_compact log_source_replay", "REPLICAOF": "streaming_log_replay",
    "SLAVEOF": "streaming_log_replay", "SYNC": "snapshot_roundtrip", "PSYNC": "log_replay_offset",
    # figures
    "INFO": "info_keyspace info_hit_rate info_stats info_commandstats info_memory", "SLOWLOG": "slowlog_top", "MONITOR": "streaming_monitor", "MEMORY": "memory_usage memory_stats memory_doctor_top10", "CLIENT": "client_list",
    "COMMAND": "command_catalogue", "PING": "admin_time_ping_echo", "ECHO": "admin_time_ping_echo", "TIME": "admin_time_ping_echo",
}

#: Features of a server process, without a meaning for tables.
WITHOUT_QUERY: dict[str, str] = {
    "CONFIG": "spark.conf",
    "AUTH": "cluster security",
    "REPLCONF": "stream checkpoints",
    "SHUTDOWN": "spark.stop",
    "QUIT": "connections",
    "SLEEP": "a test helper",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{q}')" for c, names in COMMANDS.items() for q in names.split()) + ") AS t(command, query)")
def command_catalogue(t: Tables) -> DataFrame:
    """COMMAND: which query shows which command."""
    return t.literal([(c, q) for c, names in COMMANDS.items() for q in names.split()], "command string, query string")
