"""SQL that DuckDB runs on the driver's tables, written apart from the operators."""

from __future__ import annotations

NOW = 1706000000000
SNAP = 8000

EV = """ev AS (SELECT 'user:' || user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS type,
  CASE WHEN event_type <> 'error' THEN event_type END AS value,
  CAST(CASE WHEN event_type = 'view' THEN epoch_us(ts) // 1000 + 86400000 ELSE 0 END AS BIGINT) AS expires_at_ms FROM events)"""
OD = """od AS (SELECT 'cust:' || o_custkey AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS type,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS value, CAST(0 AS BIGINT) AS expires_at_ms FROM orders)"""


def newest(log: str, name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM {log} WHERE {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


def alive(src: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM {src} WHERE type = 0 AND (expires_at_ms = 0 OR expires_at_ms > {NOW}))"


E_LIVE = f"WITH {EV}, {newest('ev', 'n')}, {alive('n', 'live')}"
E_SNAP = f"WITH {EV}, {newest('ev', 'n', f'seq <= {SNAP}')}, {alive('n', 'live')}"
O_LIVE = f"WITH {OD}, {newest('od', 'n')}, {alive('n', 'live')}"
COLUMNS = "key, seq, type, value, expires_at_ms"

RUNS = f"""WITH RECURSIVE {EV}, files AS (SELECT (seq - 1) // 1000 AS file_number, 0 AS level, min(key) AS smallest, max(key) AS largest, max(seq) AS max_seq,
  count(*) AS n_entries, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM ev GROUP BY 1)"""
LEVELS = f"""WITH {OD}, files AS (SELECT (seq - 1) // 1000 AS file_number, CAST(((seq - 1) // 1000) % 2 AS INT) AS level, min(key) AS smallest, max(key) AS largest, max(seq) AS max_seq,
  count(*) AS n_entries, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM od GROUP BY 1, 2)"""

COUNTERS = """WITH ops AS (SELECT 'user:' || user_id AS key, event_id AS pos,
   CASE event_type WHEN 'purchase' THEN 'INCRBY' WHEN 'click' THEN 'DECRBY' WHEN 'signup' THEN 'SET' WHEN 'error' THEN 'DEL' END AS op FROM events WHERE event_type <> 'view'),
 g AS (SELECT *, count(*) FILTER (op IN ('SET', 'DEL')) OVER (PARTITION BY key ORDER BY pos) AS run FROM ops),
 c AS (SELECT key, pos, op, CASE WHEN op <> 'DEL' THEN CAST(sum(CASE op WHEN 'INCRBY' THEN 1 WHEN 'DECRBY' THEN -1 WHEN 'SET' THEN 10 ELSE 0 END) OVER (PARTITION BY key, run ORDER BY pos) AS BIGINT) END AS value FROM g)"""

CHECKED = """WITH RECURSIVE ops AS (SELECT 'user:' || user_id AS key, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
   CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'SET' ELSE 'INCRBY' END AS op,
   CAST(CASE WHEN event_type = 'view' THEN 9000000000000000000 ELSE event_id END AS HUGEINT) AS by FROM events),
 f(key, rn, pos, op, num, word, value, error) AS (
   SELECT key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', CAST(0 AS HUGEINT), false, CAST(NULL AS HUGEINT), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT key FROM ops)
   UNION ALL
   SELECT o.key, o.rn, o.pos, o.op,
     CASE WHEN o.op = 'DEL' THEN 0 WHEN o.op = 'SET' OR f.word OR f.num + o.by > 9223372036854775807 THEN f.num ELSE f.num + o.by END,
     CASE o.op WHEN 'DEL' THEN false WHEN 'SET' THEN true ELSE f.word END,
     CASE WHEN o.op = 'INCRBY' AND NOT f.word AND f.num + o.by <= 9223372036854775807 THEN f.num + o.by END,
     CASE WHEN o.op = 'INCRBY' AND f.word THEN 'value is not an integer' WHEN o.op = 'INCRBY' AND f.num + o.by > 9223372036854775807 THEN 'counter overflow' END
   FROM f JOIN ops o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, pos, op, CAST(value AS BIGINT) AS value, error FROM f WHERE rn > 0"""

HASH = """WITH ops AS (SELECT 'order:' || l_orderkey AS key, 'p' || l_partkey AS field, CAST(l_quantity AS BIGINT) AS value, CASE WHEN l_returnflag = 'R' THEN 'HDEL' ELSE 'HSET' END AS op,
   l_linenumber AS line, l_suppkey AS supp, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
 live AS (SELECT key, field, value FROM (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key, field ORDER BY pos DESC) = 1) WHERE op = 'HSET')"""

LISTS = """WITH RECURSIVE ops AS (SELECT 'user:' || user_id AS key, CAST(event_id AS VARCHAR) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
   CASE event_type WHEN 'purchase' THEN 'LPOP' WHEN 'click' THEN 'RPUSH' WHEN 'error' THEN 'RPOP' WHEN 'view' THEN 'LPUSH' END AS op FROM events WHERE event_type <> 'signup'),
 f(key, rn, a) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM ops
   UNION ALL SELECT o.key, o.rn, CASE o.op WHEN 'LPUSH' THEN list_prepend(o.s, f.a) WHEN 'RPUSH' THEN list_append(f.a, o.s) WHEN 'LPOP' THEN f.a[2:]
     ELSE CASE WHEN len(f.a) > 1 THEN f.a[:len(f.a) - 1] ELSE CAST([] AS VARCHAR[]) END END FROM f JOIN ops o ON o.key = f.key AND o.rn = f.rn + 1),
 done AS (SELECT key, a FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1)"""

FNV = """list_reduce(list_prepend(1469598103934665603::HUGEINT, list_transform(range(1, strlen({k}) + 1), lambda i: CAST(ascii({k}[i]) AS HUGEINT))),
   lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""
NODES = "nodes AS (SELECT * FROM (VALUES ('n1', 1, true), ('n2', 2, true), ('n3', 1, true), ('n4', 1, false)) t(id, weight, alive))"
RING = f"""WITH {NODES}, vn AS (SELECT id, unnest(range(0, weight * 8)) AS i FROM nodes WHERE alive),
 named AS (SELECT id, i, id || '#' || i AS k FROM vn), tok AS (SELECT id, i, {FNV.format(k='k')} AS token FROM named),
 keys AS (SELECT c_custkey AS pos, 'cust:' || c_custkey AS key FROM customer), hashed AS (SELECT pos, key, {FNV.format(k='key')} AS h FROM keys),
 walk AS (SELECT pos, key, id, row_number() OVER (PARTITION BY key ORDER BY (token < h), token) AS r FROM hashed, tok),
 per AS (SELECT pos, key, id, min(r) AS r FROM walk GROUP BY ALL), ranked AS (SELECT pos, key, id AS node, row_number() OVER (PARTITION BY key ORDER BY r) - 1 AS rank FROM per)"""

CACHE = """WITH RECURSIVE e AS (SELECT CAST(user_id % 4 AS VARCHAR) AS shard, event_id AS pos, epoch_us(ts) // 1000 AS t, CAST(user_id % 48 AS VARCHAR) AS k, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn,
   CASE WHEN event_type = 'view' THEN 'GET' WHEN event_type IN ('click', 'purchase') THEN 'PUT' WHEN event_type = 'signup' THEN 'CONTAINS' ELSE 'ERASE' END AS op,
   CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN epoch_us(ts) // 1000 + (event_id % 3) * 3600000 ELSE 0 END AS x FROM events),
 f(shard, rn, pos, op, outcome, evicted, held) AS (SELECT DISTINCT shard, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', '', CAST(0 AS BIGINT), CAST([] AS STRUCT(k VARCHAR, x BIGINT)[]) FROM e
   UNION ALL SELECT shard, rn, pos, op, CASE op WHEN 'PUT' THEN 'put' WHEN 'ERASE' THEN 'erased' ELSE CASE WHEN own IS NULL THEN if(op = 'GET', 'miss', 'no') WHEN own.x > 0 AND own.x <= t THEN 'expired' ELSE if(op = 'GET', 'hit', 'yes') END END,
     CASE WHEN op = 'PUT' AND len(rest) >= 8 THEN 1 ELSE 0 END,
     CASE WHEN op = 'PUT' THEN list_append(CASE WHEN len(rest) >= 8 THEN rest[2:] ELSE rest END, {'k': k, 'x': x}) WHEN op = 'ERASE' OR (own.x > 0 AND own.x <= t) THEN rest
       WHEN op = 'GET' AND own IS NOT NULL THEN list_append(rest, own) ELSE held END
   FROM (SELECT e.*, held, list_filter(held, lambda h: h.k <> e.k) AS rest, list_filter(held, lambda h: h.k = e.k)[1] AS own FROM f JOIN e ON e.shard = f.shard AND e.rn = f.rn + 1))"""

APPENDS = """WITH o AS (SELECT o_orderkey + 1 AS idx, o_orderstatus AS data FROM orders),
 a AS (SELECT idx * 4 AS pos, idx, 1 AS term, data FROM o UNION ALL SELECT idx * 4 + 122, idx, idx // 100 + 2, 'other' FROM o WHERE idx % 100 = 40),
 left_over AS (SELECT idx, CAST(term AS BIGINT) AS term, data FROM (SELECT *, max(pos) OVER (ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM a) WHERE pos = upto)"""


def rep(text: str) -> str:
    """A wire reply as an SQL string expression, line ends spelled as \\r\\n."""
    return "'" + text.replace("'", "''").replace("\r\n", "' || chr(13) || chr(10) || '").replace("\n", "' || chr(10) || '") + "'"


def by_nation(columns: str, rows: list[tuple]) -> str:
    """VALUES of (i, …) for each nation; text that starts with = is an SQL expression in k, the nation's number."""
    lit = lambda v: "NULL" if v is None else v[1:] if isinstance(v, str) and v.startswith("=") else rep(v) if isinstance(v, str) else str(v)
    each = [f"SELECT n_name AS nation, k, {i} AS i, " + ", ".join(f"{lit(v)} AS {c}" for c, v in zip(columns.split(), rest, strict=True)) + " FROM n" for i, *rest in rows]
    return f"WITH n AS (SELECT n_name, CAST(n_nationkey AS BIGINT) AS k FROM nation), t AS (SELECT *, k * 100 + i AS pos FROM ({' UNION ALL '.join(each)}))"


def little(n: str, size: int = 4) -> str:
    """The hexadecimal digits of a whole number's bytes, the least first."""
    return "(" + " || ".join(f"lpad(lower(hex(CAST({n} AS BIGINT) // {1 << 8 * k} % 256)), 2, '0')" for k in range(size)) + ")"


def err(text: str) -> str:
    return f"-ERR{text}\r\n"


OK, NIL = "+OK\r\n", "$-1\r\n"
LINES_OF = {"n1": "id=n1 address=127.0.0.1:9001 weight=1 alive=1", "n2": "id=n2 address=127.0.0.1:9002 weight=2 alive=1", "n3": "id=n3 address=127.0.0.1:9003 weight=1 alive=1", "n4": "id=n4 address=127.0.0.1:9004 weight=1 alive=0"}
STATUS = "\n".join(["cluster.node_count=4", "cluster.active_node_count=3"] + [f"node[{k}].{v}" for k, v in enumerate(LINES_OF.values())])
STATS = "\n".join(f"{n}=0" for n in (
    "cache.hit cache.miss cache.evict cache.expire read.table_cache_hits read.table_cache_misses read.table_cache_evictions read.table_cache_entries read.bloom_queries read.bloom_negatives read.range_prunes "
    "compaction.trigger_attempts compaction.skipped_due_snapshot compaction.skipped_due_threshold compaction.succeeded compaction.failed compaction.input_bytes compaction.output_bytes compaction.duration_us").split())
bulk = lambda t: f"${len(t)}\r\n{t}\r\n"


CLAIMS = f"""WITH RECURSIVE ops AS (SELECT 'user:' || user_id AS key, event_id AS pos, epoch_us(ts) // 1000 AS ts_ms, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
 f(key, rn, pos, ts_ms, value, until, took) AS (SELECT key, rn, pos, ts_ms, value, ts_ms + 86400000, true FROM ops WHERE rn = 1
   UNION ALL SELECT o.key, o.rn, o.pos, o.ts_ms, o.value, CASE WHEN o.ts_ms >= f.until THEN o.ts_ms + 86400000 ELSE f.until END, o.ts_ms >= f.until FROM f JOIN ops o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, pos, ts_ms, value, until AS expires_at_ms FROM f WHERE took"""

EXPIRE_REQ = "req AS (SELECT DISTINCT user_id AS pos, 'user:' || user_id AS key, CAST((user_id % 5 - 1) * 1000 AS BIGINT) AS ttl_ms FROM events)"

LRU = """WITH t AS (SELECT event_type AS shard, event_id AS pos, user_id AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
 p AS (SELECT *, lag(rn) OVER (PARTITION BY shard, k ORDER BY rn) AS before FROM t),
 d AS (SELECT p.shard, p.pos, p.before, (SELECT count(DISTINCT q.k) FROM t q WHERE q.shard = p.shard AND q.rn > p.before AND q.rn < p.rn) AS between_ FROM p),
 hits AS (SELECT shard, pos, before IS NOT NULL AND between_ < 8 AS hit FROM d)"""

RAFT = """WITH o AS (SELECT o_orderkey + 1 AS idx, o_orderkey // 1000 + 1 AS term, o_orderstatus AS data FROM orders),
 e AS (SELECT * FROM (SELECT * FROM o UNION ALL SELECT idx, term + 1, 'again' FROM o WHERE idx % 10 = 0) WHERE NOT (idx >= 500 AND idx % 7 = 1))"""

LINES = """lines AS (SELECT event_id AS pos, user_id, event_type, CASE event_type WHEN 'view' THEN 'get s:' || user_id
   WHEN 'click' THEN 'SET s:' || user_id || ' v' || event_id || CASE WHEN event_id % 3 = 0 THEN ' EX 3600' ELSE '' END
   WHEN 'purchase' THEN 'INCRBY c:' || user_id || ' ' || event_id WHEN 'signup' THEN 'LPUSH l:' || user_id || ' ' || event_id
   ELSE CASE WHEN event_id % 2 = 0 THEN 'nonsense ' || event_id ELSE 'EXPIRE s:' || user_id || ' x' END END AS line FROM events)"""
REPLAY = f"""WITH {LINES}, e AS (SELECT l.*, epoch_us(ts) // 1000 AS t FROM lines l JOIN events USING (event_type, user_id) WHERE events.event_id = l.pos),
 s AS (SELECT e.*, max(CASE WHEN event_type = 'click' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS set_at,
   CAST(sum(CASE WHEN event_type = 'purchase' THEN pos ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS total,
   count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY pos) AS pushed FROM e),
 r AS (SELECT 'u' || s.user_id AS part, s.pos, CASE s.event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'SET' WHEN 'purchase' THEN 'INCRBY' WHEN 'signup' THEN 'LPUSH'
     ELSE CASE WHEN s.pos % 2 = 0 THEN 'INVALID' ELSE 'EXPIRE' END END AS op,
   CASE s.event_type WHEN 'view' THEN CASE WHEN w.pos IS NULL OR (w.pos % 3 = 0 AND w.t + 3600000 <= s.t) THEN '$-1' ELSE '$' || (1 + strlen(CAST(w.pos AS VARCHAR))) || chr(13) || chr(10) || 'v' || w.pos END WHEN 'click' THEN '+OK'
     WHEN 'purchase' THEN ':' || total WHEN 'signup' THEN ':' || pushed ELSE CASE WHEN s.pos % 2 = 0 THEN '-ERRunknown command' ELSE '-ERRinvalid TTL value for ''EXPIRE''' END END || chr(13) || chr(10) AS reply
   FROM s LEFT JOIN e w ON w.pos = s.set_at)"""

SCHEDULE = """WITH RECURSIVE t AS (SELECT o_orderkey + 1 AS txn, greatest(o_orderkey - 49, 0) AS start_seq, o_custkey AS k, o_orderkey AS pos,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
 f(k, rn, txn, last, ok) AS (SELECT k, rn, txn, pos + 1, true FROM t WHERE rn = 1
   UNION ALL SELECT t.k, t.rn, t.txn, CASE WHEN f.last > t.start_seq THEN f.last ELSE t.pos + 1 END, f.last <= t.start_seq FROM f JOIN t ON t.k = f.k AND t.rn = f.rn + 1)
 SELECT txn, ok AS committed FROM f"""

CUST = "req AS (SELECT c_custkey AS pos, 'cust:' || c_custkey AS key FROM customer)"

H = "CAST('0x' || substr(md5({k}), {at}, 8) AS BIGINT)"
BLOOM = f"""WITH {EV}, fk AS (SELECT DISTINCT (seq - 1) // 1000 AS file_number, key FROM ev), sized AS (SELECT (seq - 1) // 1000 AS file_number, count(*) * 10 AS n_bits FROM ev GROUP BY 1),
 b AS (SELECT file_number, n_bits, unnest(list_transform(range(4), lambda i: ({H.format(k='key', at=1)} + i * {H.format(k='key', at=9)}) % n_bits)) AS p FROM fk JOIN sized USING (file_number))"""

SQL: dict[str, str] = {
    "kv_live_state": f"{E_LIVE} SELECT {COLUMNS} FROM live",
    "kv_live_orders": f"{O_LIVE} SELECT {COLUMNS} FROM live",
    "kv_snapshot_state": f"{E_SNAP} SELECT {COLUMNS} FROM live",
    "kv_get_point": f"{O_LIVE} SELECT key, value, seq FROM live WHERE key = 'cust:7'",
    "kv_mget_positional": f"{O_LIVE}, {CUST} SELECT pos, key, value FROM req LEFT JOIN live USING (key)",
    "kv_mget_negative": "SELECT c_custkey AS pos, 'missing' || c_custkey AS key, CAST(NULL AS VARCHAR) AS value FROM customer",
    "kv_exists": f"{O_LIVE}, {CUST} SELECT pos, key, value IS NOT NULL AS present FROM req LEFT JOIN live USING (key)",
    "kv_scan_range_limit": f"{O_LIVE} SELECT key, value FROM live WHERE key >= 'cust:1' AND key < 'cust:5' ORDER BY key LIMIT 100",
    "kv_scan_range_all": f"{O_LIVE} SELECT key, value FROM live WHERE key >= 'cust:1' AND key < 'cust:5'",
    "kv_scan_flat": f"{O_LIVE}, p AS (SELECT key, value FROM live WHERE key >= 'cust:2' ORDER BY key LIMIT 100) SELECT key, 0 AS item, key AS text FROM p UNION ALL SELECT key, 1, value FROM p",
    "kv_prefix": f"{O_LIVE} SELECT key, value FROM live WHERE starts_with(key, 'cust:12')",
    "kv_next_key": f"{O_LIVE} SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live",
    "kv_seek": f"{O_LIVE} SELECT key, value FROM live WHERE key >= 'cust:33' ORDER BY key LIMIT 1",
    "kv_versions_order": f"WITH {EV} SELECT key, seq, type, row_number() OVER (PARTITION BY key ORDER BY seq DESC, type) AS nth FROM ev",
    "kv_deleted_keys": f"WITH {EV}, {newest('ev', 'n')} SELECT key, seq FROM n WHERE type = 1",
    "kv_expired_keys": f"WITH {EV}, {newest('ev', 'n')} SELECT key, seq, expires_at_ms FROM n WHERE expires_at_ms <> 0 AND expires_at_ms <= 1707000000000",
    "kv_ttl": f"""{E_LIVE}, req AS (SELECT DISTINCT user_id AS pos, 'user:' || (user_id - 1) AS key FROM events),
      t AS (SELECT pos, key, CAST(CASE WHEN seq IS NULL THEN -2 WHEN expires_at_ms = 0 THEN -1 ELSE expires_at_ms - {NOW} END AS BIGINT) AS pttl_ms FROM req LEFT JOIN live USING (key))
      SELECT pos, key, pttl_ms, CASE WHEN pttl_ms < 0 THEN pttl_ms ELSE pttl_ms // 1000 END AS ttl_s FROM t""",
    "kv_ttl_snapshot": f"""{E_SNAP}, req AS (SELECT DISTINCT user_id AS pos, 'user:' || user_id AS key FROM events),
      t AS (SELECT pos, key, CAST(CASE WHEN seq IS NULL THEN -2 WHEN expires_at_ms = 0 THEN -1 ELSE expires_at_ms - {NOW} END AS BIGINT) AS pttl_ms FROM req LEFT JOIN live USING (key))
      SELECT pos, key, pttl_ms, CASE WHEN pttl_ms < 0 THEN pttl_ms ELSE pttl_ms // 1000 END AS ttl_s FROM t""",
    "kv_expiry_schedule": f"WITH {EV}, {newest('ev', 'n')} SELECT key, expires_at_ms FROM n WHERE type = 0 AND expires_at_ms <> 0",
    "kv_expire_effect": f"""{E_LIVE}, {EXPIRE_REQ}, j AS (SELECT pos, key, ttl_ms, value FROM req LEFT JOIN live USING (key))
      SELECT pos, key, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS reply, CASE WHEN value IS NOT NULL THEN CASE WHEN ttl_ms <= 0 THEN 1 ELSE 0 END END AS type,
      CASE WHEN ttl_ms > 0 THEN value END AS value, CAST(CASE WHEN value IS NOT NULL THEN CASE WHEN ttl_ms <= 0 THEN 0 ELSE {NOW} + ttl_ms END END AS BIGINT) AS expires_at_ms FROM j""",
    "kv_persist_effect": f"""{E_LIVE}, {EXPIRE_REQ} SELECT pos, key, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS reply, coalesce(expires_at_ms <> 0, false) AS writes, value FROM req LEFT JOIN live USING (key)""",
    "kv_batch_apply": """SELECT 'cust:' || o_custkey AS key, 1000000 + row_number() OVER (ORDER BY o_orderkey) AS seq, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS type,
      CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS value, CAST(0 AS BIGINT) AS expires_at_ms FROM orders""",
    "kv_batch_size": "SELECT count(*) AS n_ops, CAST(sum(strlen('cust:' || o_custkey) + strlen(o_orderpriority) + 1) AS BIGINT) AS bytes FROM orders",
    "kv_latest_seq": f"WITH {OD} SELECT key, max(seq) AS seq FROM od GROUP BY key",
    "kv_log_faults": f"""WITH {EV}, s AS (SELECT CASE WHEN seq % 97 = 0 THEN '' ELSE key END AS key, type, CASE WHEN type = 1 THEN seq % 2 ELSE 0 END AS x FROM ev)
      SELECT CASE WHEN key = '' THEN 'empty key' ELSE 'deletion with an expiry' END AS reason, count(*) AS n FROM s WHERE key = '' OR x <> 0 GROUP BY 1""",
    "txn_conflicts": f"""WITH {OD}, l AS (SELECT key, max(seq) AS seq FROM od GROUP BY key), t AS (SELECT o_orderkey + 1 AS txn, greatest(o_orderkey - 49, 0) AS start_seq, 'cust:' || o_custkey AS key FROM orders)
      SELECT txn, coalesce(seq > start_seq, false) AS conflict FROM t LEFT JOIN l USING (key)""",
    "txn_schedule": SCHEDULE,
    "txn_read_own_writes": f"""WITH {OD}, t AS (SELECT o_orderkey + 1 AS txn, greatest(o_orderkey - 49, 0) AS start_seq, 'cust:' || o_custkey AS key, o_orderpriority AS v FROM orders),
      a AS (SELECT t.*, (SELECT arg_max(CASE WHEN type = 0 THEN value ELSE '' END, seq) FROM od WHERE od.key = t.key AND od.seq <= t.start_seq) AS seen FROM t)
      SELECT txn, key, CASE WHEN txn % 3 = 0 THEN CASE WHEN txn % 2 = 0 THEN v END ELSE nullif(seen, '') END AS value, txn % 3 <> 0 AS tracked FROM a""",
    "txn_write_dedup": """WITH w AS (SELECT l_orderkey // 10 AS txn, l_orderkey * 1000 + l_linenumber * 100 + (l_partkey * 7 + l_suppkey) % 100 AS pos,
        CASE WHEN l_returnflag = 'R' THEN 'DEL' ELSE 'PUT' END AS op, 'part:' || (l_partkey % 50) AS key, l_linestatus AS value FROM lineitem),
      u AS (SELECT txn, key, pos, min((op, value)) AS x FROM w GROUP BY ALL)
      SELECT txn, min(pos) AS pos, key, arg_max(x[1], pos) AS op, arg_max(x[2], pos) AS value FROM u GROUP BY txn, key""",
    "counter_replay": f"{COUNTERS} SELECT key, pos, op, value FROM c",
    "counter_final": f"{COUNTERS} SELECT key, value FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1) WHERE op <> 'DEL'",
    "counter_checked": CHECKED,
    "hash_hgetall": f"{HASH} SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS items FROM live GROUP BY key",
    "hash_hkeys": f"{HASH} SELECT key, string_agg(field, ',' ORDER BY field) AS fields FROM live GROUP BY key",
    "hash_hvals": f"{HASH} SELECT key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY field) AS vals FROM live GROUP BY key",
    "hash_hlen": f"{HASH} SELECT key, count(*) AS n FROM live GROUP BY key",
    "hash_hget": f"""{HASH}, req AS (SELECT o_orderkey AS pos, 'order:' || o_orderkey AS key, 'p' || (o_custkey % 50) AS field FROM orders)
      SELECT pos, key, field, value, value IS NOT NULL AS present FROM req LEFT JOIN live USING (key, field)""",
    "hash_replies": f"""{HASH}, b AS (SELECT *, lag(op) OVER (PARTITION BY key, field ORDER BY pos) AS before FROM ops)
      SELECT key, field, op, line, supp, CASE WHEN (op = 'HSET') = (coalesce(before, '') <> 'HSET') THEN 1 ELSE 0 END AS reply FROM b""",
    "hash_hdel_empty_key": f"{HASH} SELECT DISTINCT key FROM ops WHERE op = 'HSET' AND key NOT IN (SELECT key FROM live)",
    "list_final": f"{LISTS} SELECT key, array_to_string(a, ',') AS items FROM done WHERE len(a) > 0",
    "list_lrange": f"{LISTS} SELECT key, array_to_string(a[2:4], ',') AS inner_part, array_to_string(a[greatest(len(a) - 2, 1):], ',') AS tail_part, '' AS before_part FROM done WHERE len(a) > 0",
    "list_lindex": f"{LISTS} SELECT key, a[1] AS first, a[len(a)] AS last, a[3] AS third, CAST(NULL AS VARCHAR) AS none FROM done WHERE len(a) > 0",
    "list_llen": f"{LISTS} SELECT u.key, CAST(coalesce(len(a), 0) AS BIGINT) AS n FROM (SELECT DISTINCT 'user:' || user_id AS key FROM events) u LEFT JOIN done ON done.key = u.key",
    "nx_claims": CLAIMS,
    "nx_first_writer": "SELECT 'user:' || user_id AS key, min(event_id) + 1 AS seq, arg_min(event_type, event_id) AS value FROM events GROUP BY user_id",
    "merge_sources": f"{E_LIVE} SELECT {COLUMNS} FROM live",
    "wal_replay_dedup": f"WITH {EV}, {newest('ev', 'n')} SELECT key, seq, type FROM n",
    "wal_segment_retention": f"WITH {EV}, s AS (SELECT (seq - 1) // 1000 AS segment, max(seq) AS max_seq FROM ev GROUP BY 1) SELECT segment, max_seq FROM s WHERE segment < (SELECT max(segment) FROM s) AND max_seq <= {SNAP}",
    "wal_segment_names": "SELECT DISTINCT event_id // 1000 AS segment, lpad(CAST(event_id // 1000 AS VARCHAR), 20, '0') || '.wal' AS name FROM events",
    "ring_hash": f"{RING} SELECT key, CAST(h AS VARCHAR) AS hash FROM hashed",
    "ring_tokens": f"{RING} SELECT id, i, CAST(token AS VARCHAR) AS token FROM tok",
    "ring_route": f"{RING} SELECT pos, key, node FROM ranked WHERE rank = 0",
    "ring_replicas": f"{RING} SELECT key, rank, node FROM ranked WHERE rank < 2",
    "batch_plan": f"""{RING}, a AS (SELECT pos, key, node FROM ranked WHERE rank = 0), g AS (SELECT node, row_number() OVER (ORDER BY min(pos)) - 1 AS grp FROM a GROUP BY node)
      SELECT pos, key, node, grp, row_number() OVER (PARTITION BY node ORDER BY pos) - 1 AS nth FROM a JOIN g USING (node)""",
    "batch_single_node_check": f"""{RING}, a AS (SELECT key, node FROM ranked WHERE rank = 0), o AS (SELECT o_orderkey // 2 AS batch, 'cust:' || o_custkey AS key FROM orders)
      SELECT batch, count(DISTINCT node) = 1 AS single, count(DISTINCT node) = 1 AND min(node) = 'n1' AS executable FROM o JOIN a USING (key) GROUP BY batch""",
    "cluster_status": f"WITH {NODES} SELECT count(*) AS node_count, count(*) FILTER (alive) AS active_node_count, string_agg(id, ',' ORDER BY id) AS ids FROM nodes",
    "file_metadata": f"{RUNS} SELECT * FROM files",
    "compaction_pick": f"""{LEVELS}, l AS (SELECT min(level) AS l FROM files), u AS (SELECT min(smallest) AS lo, max(largest) AS hi, count(*) AS n FROM files, l WHERE level = l)
      SELECT file_number, level FROM files, l, u WHERE n >= 2 AND (level = l OR (level = l + 1 AND NOT (largest < lo OR smallest > hi)))""",
    "compaction_due": f"""{LEVELS}, c AS (SELECT count(*) FILTER (level = 0) AS n0, count(*) FILTER (level = 1) AS n1, CAST(coalesce(sum(bytes) FILTER (level = 1), 0) AS BIGINT) AS b1 FROM files)
      SELECT n0, n1, b1, CASE WHEN n0 >= 2 THEN 'L0' WHEN n1 >= 2 AND b1 >= 268435456 THEN 'L1' END AS due FROM c""",
    "compaction_merge_l1": f"WITH {EV}, {newest('ev', 'n')} SELECT {COLUMNS} FROM n",
    "compaction_merge_l2": f"{E_LIVE} SELECT {COLUMNS} FROM live",
    "manifest_live_files": f"{RUNS} SELECT file_number, file_number * 2 AS first_add FROM files WHERE file_number % 2 = 1",
    "range_prune_stats": f"""{RUNS}, req AS (SELECT DISTINCT user_id AS pos, 'user:' || user_id AS key FROM events)
      SELECT pos, key, count(*) FILTER (key < smallest OR key > largest) AS pruned, count(*) FILTER (NOT (key < smallest OR key > largest)) AS must_read FROM req, files GROUP BY pos, key""",
    "lru_hits": f"{LRU} SELECT shard, pos, hit FROM hits",
    "cache_stats": f"{LRU} SELECT shard, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM hits GROUP BY shard",
    "lfu_hits": """WITH RECURSIVE e AS (SELECT event_type AS shard, event_id AS pos, CAST(user_id AS VARCHAR) AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
      f(shard, rn, pos, held, hit) AS (SELECT DISTINCT shard, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS STRUCT(k VARCHAR, n BIGINT, s BIGINT)[]), false FROM e
        UNION ALL SELECT e.shard, e.rn, e.pos, list_append(CASE WHEN list_contains(list_transform(held, lambda x: x.k), e.k) THEN list_filter(held, lambda x: x.k <> e.k)
            WHEN len(held) < 8 THEN held ELSE list_filter(held, lambda x: x.n * 1000000000 + x.s <> list_min(list_transform(held, lambda y: y.n * 1000000000 + y.s))) END,
            {'k': e.k, 'n': coalesce(list_filter(held, lambda x: x.k = e.k)[1].n, 0) + 1, 's': e.rn}),
          list_contains(list_transform(held, lambda x: x.k), e.k) FROM f JOIN e ON e.shard = f.shard AND e.rn = f.rn + 1)
      SELECT shard, pos, hit FROM f WHERE rn > 0""",
    "lock_trace": """WITH RECURSIVE e AS (SELECT 'r' || user_id % 10 AS key, event_id AS pos, CAST(user_id + 1 AS BIGINT) AS who, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS rn,
        CASE WHEN event_type IN ('view', 'click') THEN 'S' WHEN event_type = 'purchase' THEN 'X' ELSE 'UNLOCK' END AS op FROM events),
      f(key, rn, pos, readers, writer, granted) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), false FROM e
        UNION ALL SELECT key, rn, pos, CASE WHEN op = 'S' AND g AND writer <> who THEN list_append(others, who) WHEN op = 'UNLOCK' OR (op = 'X' AND g) THEN others ELSE readers END,
          CASE WHEN op = 'X' AND g THEN who WHEN op = 'UNLOCK' AND writer = who THEN 0 ELSE writer END, g
        FROM (SELECT e.*, readers, writer, list_filter(readers, lambda x: x <> who) AS others,
            CASE op WHEN 'UNLOCK' THEN list_contains(readers, who) OR writer = who WHEN 'S' THEN writer IN (0, who) ELSE writer = who OR (writer = 0 AND len(list_filter(readers, lambda x: x <> who)) = 0) END AS g
          FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1))
      SELECT key, pos, granted FROM f WHERE rn > 0""",
    "kv_put_delete": f"""WITH {OD}, x AS (SELECT * FROM od UNION ALL VALUES ('cust:7', 1099511627776, 0, 'new', 0), ('fresh', 1099511627777, 0, 'x', {NOW + 1000}), ('cust:8', 1099511627778, 1, NULL, 0), ('none', 1099511627779, 1, NULL, 0)),
      {newest('x', 'n')}, {alive('n', 'live')} SELECT {COLUMNS} FROM live""",
    "wal_round_trip": f"WITH {EV} SELECT {COLUMNS} FROM ev",
    "resp_round_trip": "SELECT 2 AS argc, 'cust:' || c_custkey AS key, CAST(NULL AS VARCHAR) AS fault FROM customer",
    "run_point_get": f"{O_LIVE} SELECT key, value, seq FROM live WHERE key = 'cust:7'",
    "run_range_scan": f"{O_LIVE} SELECT key, value FROM live WHERE key >= 'cust:1' AND key < 'cust:5'",
    "store_compacted": f"{E_LIVE} SELECT {COLUMNS} FROM live",
    "store_installed": f"{O_LIVE} SELECT {COLUMNS} FROM live",
    "snapshot_read": f"WITH {EV}, {newest('ev', 'n', 'seq <= 4000')}, {alive('n', 'live')} SELECT {COLUMNS} FROM live",
    "pessimistic_trace": by_nation("txn reply error", [
        (1, 1, "OK", None), (2, 2, None, "write conflict"), (3, 2, None, None), (4, 1, "a", None), (5, 1, "OK", None), (6, 2, "=CASE WHEN k % 2 = 0 THEN 'a' END", None), (7, 2, "OK", None), (8, 2, "OK", None), (9, 3, None, None),
    ]) + " SELECT pos, CAST(txn AS BIGINT) AS txn, reply, error FROM t",
    "counter_limits": by_nation("op value error", [
        (1, "DECRBY", None, "counter overflow"), (2, "INCRBY", "=-9223372036854775808", None), (3, "DECRBY", None, "counter overflow"), (4, "INCRBY", None, "value is not an integer"), (5, "INCRBY", -1, None), (6, "DECRBY", 0, None),
        (7, "SET", None, None), (8, "INCRBY", 13, None), (9, "DEL", None, None), (10, "DECRBY", -5, None),
    ]) + " SELECT nation AS key, pos, op, CAST(value AS BIGINT) AS value, error FROM t",
    "list_queue_and_stack": "SELECT 'queue:' || n_name AS key, '3,4' AS items FROM nation UNION ALL SELECT 'stack:' || n_name, '3,1' FROM nation",
    "command_sessions": by_nation("op reply", [(i, *x) for i, x in enumerate([
        ("GET", err("NOAUTH authentication required")), ("AUTH", err("invalid password")), ("AUTH", OK), ("AUTH", OK), ("SET", OK), ("BEGIN", OK), ("GET", bulk("1")), ("SET", OK), ("GET", bulk("2")),
        ("INCR", err("unsupported command in transaction")), ("=CASE WHEN k % 2 = 0 THEN 'SET' ELSE 'GET' END", f"=CASE WHEN k % 2 = 0 THEN {rep(OK)} ELSE {rep(bulk('1'))} END"), ("INFO", err("wrong number of arguments for 'INFO/STATS'")),
        ("CLUSTER", err("cluster batch is not supported in transaction")), ("EXEC", f"=CASE WHEN k % 2 = 0 THEN {rep(err('transaction conflict'))} ELSE {rep(OK)} END"),
        ("GET", f"=CASE WHEN k % 2 = 0 THEN {rep(bulk('9'))} ELSE {rep(bulk('2'))} END"), ("BEGIN", OK), ("BEGIN", err("transaction already active")), ("DEL", OK), ("ABORT", OK),
        ("GET", f"=CASE WHEN k % 2 = 0 THEN {rep(bulk('9'))} ELSE {rep(bulk('2'))} END"), ("EXEC", err("no active transaction")), ("CLUSTER", err("wrong number of arguments for 'CLUSTER'")), ("CLUSTER", err("cluster manager is null")),
        ("AUTH", err("wrong number of arguments for 'AUTH'")), ("BEGIN", err("wrong number of arguments for 'BEGIN'")), ("GET", err("NOAUTH authentication required")), ("HSET", err("Corruption: hash encoding corrupted")), ("INVALID", err("unknown command")),
    ])]) + " SELECT nation AS part, pos, op, reply FROM t",
    "cluster_replies": RING + ", " + by_nation("op reply", [(i, *x) for i, x in enumerate([
        ("CLUSTER", bulk(STATUS)), ("CLUSTER", bulk(LINES_OF["n2"])), ("CLUSTER", err("node not found")), ("CLUSTER", err("wrong number of arguments for 'CLUSTER ROUTE'")), ("CLUSTER", err("invalid replica count for 'CLUSTER ROUTE'")),
        ("CLUSTER", err("unknown cluster command")), ("CLUSTER", err("wrong number of arguments for 'CLUSTER BATCH SET'")), ("CLUSTER", err("wrong number of arguments for 'CLUSTER BATCH DEL'")),
        ("CLUSTER", err("unsupported operation for 'CLUSTER BATCH'")), ("STATS", bulk(STATS)), ("INFO", err("wrong number of arguments for 'INFO/STATS'")), ("GET", NIL),
    ])]).removeprefix("WITH ") + " SELECT nation AS part, pos, op, reply FROM t UNION ALL SELECT 'r' || pos % 8, pos + 10000, 'CLUSTER', CASE node " + " ".join(
        f"WHEN '{n}' THEN {rep('*1' + chr(13) + chr(10) + bulk(v))}" for n, v in LINES_OF.items()) + " END FROM ranked WHERE rank = 0",
    "ring_membership": """WITH n AS (SELECT n_name AS id, CAST(n_nationkey AS INT) AS k FROM nation WHERE n_nationkey > 0)
      SELECT id, CASE WHEN k % 10 = 1 THEN 'again' ELSE 'h' END AS host, k AS port, CAST(k % 3 AS INT) AS weight, k % 10 <> 1 AND (k % 3 <> 0 OR k % 6 = 0) AS alive FROM n WHERE k % 5 <> 1 OR k % 10 = 1""",
    "ring_route_all": f"{RING} SELECT pos, key, node FROM ranked WHERE rank = 0",
    "raft_truncated_log": f"{APPENDS} SELECT idx, term, data FROM left_over",
    "raft_compacted_log": f"{APPENDS} SELECT idx, term, data FROM left_over WHERE idx > 500",
    "raft_lag": f"{RAFT} SELECT n_name AS node, greatest((SELECT max(idx) FROM e) - (n_nationkey * 60 + n_regionkey), 0) AS lag FROM nation",
    "manifest_recovered": f"{RUNS} SELECT file_number + 1 AS file_number, max_seq, 'f' || (file_number + 1) AS path, level, bytes, smallest, largest FROM files WHERE file_number % 2 = 1",
    "file_listing": f"{LEVELS} SELECT level, row_number() OVER (PARTITION BY level ORDER BY file_number) - 1 AS nth, file_number, lower(hex(smallest)) AS smallest, lower(hex(largest)) AS largest, n_entries, bytes FROM files",
    "ttl_deadlines": f"""WITH l AS (SELECT 'user:' || user_id AS key, epoch_us(ts) // 1000 AS t, event_type, CASE WHEN event_id % 4 = 0 THEN 3600000 ELSE (event_id % 4 - 1) * 86400000 END AS ttl
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
      SELECT key, t + ttl AS expires_at_ms, t + ttl <= {NOW} AS purged FROM l WHERE event_type <> 'error' AND ttl > 0""",
    "raft_commands": f"""WITH c AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'S' WHEN 'click' THEN 'T' WHEN 'purchase' THEN 'E' WHEN 'error' THEN 'D' ELSE 'N' END AS op, 'user:' || user_id AS key, event_type AS value, epoch_us(ts) // 1000 AS t FROM events),
      h AS (SELECT *, lpad(lower(hex(strlen(key))), 8, '0') || lower(hex(key)) AS k, lpad(lower(hex(strlen(value))), 8, '0') || lower(hex(value)) AS v, lpad(lower(hex(t)), 16, '0') AS x FROM c)
      SELECT event_id, lower(hex(op)) || CASE op WHEN 'S' THEN k || v WHEN 'T' THEN k || v || x WHEN 'E' THEN k || x WHEN 'D' THEN k ELSE '' END AS bytes, op, CASE WHEN op = 'N' THEN '' ELSE key END AS key,
        CASE WHEN op IN ('S', 'T') THEN value ELSE '' END AS value, CASE WHEN op IN ('T', 'E') THEN t ELSE 0 END AS expires_at_ms FROM h""",
    "hash_encoded": f"""{HASH} SELECT key, {little('count(*)')} || string_agg({little('strlen(field)')} || lower(hex(field)) || {little('strlen(value::VARCHAR)')} || lower(hex(value::VARCHAR)), '' ORDER BY field) AS bytes FROM live GROUP BY key""",
    "hash_decoded": f"{HASH} SELECT key, string_agg(field || ',' || value, ',' ORDER BY field) AS items FROM live GROUP BY key",
    "list_encoded": f"""{LISTS} SELECT key, {little('len(a)')} || array_to_string(list_transform(a, lambda x: {little('strlen(x)')} || lower(hex(x))), '') AS bytes FROM done WHERE len(a) > 0""",
    "list_decoded": f"{LISTS} SELECT key, array_to_string(a, ',') AS items FROM done WHERE len(a) > 0",
    "value_envelopes": f"""WITH {EV} SELECT seq, CASE WHEN expires_at_ms = 0 THEN '' ELSE '4b5654544c303031' || {little('expires_at_ms', 8)} END || lower(hex(value)) AS bytes, value, expires_at_ms FROM ev WHERE type = 0""",
    "follower_replies": f"""WITH {LINES} SELECT 'u' || user_id AS part, pos, CASE WHEN h = 'NONSENSE' THEN 'INVALID' ELSE h END AS op,
      CASE WHEN h = 'GET' THEN {rep(NIL)} WHEN h = 'NONSENSE' THEN {rep(err('unknown command'))} ELSE {rep('-MOVED 127.0.0.1:7001' + chr(13) + chr(10))} END AS reply
      FROM (SELECT *, upper(split_part(line, ' ', 1)) AS h FROM lines)""",
    "read_sources": """WITH e AS (SELECT event_id AS pos, user_id, epoch_us(ts) // 1000 AS t, event_type, event_type IN ('view', 'click') AS reads FROM events),
      w AS (SELECT *, max(CASE WHEN NOT reads THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written,
        max(CASE WHEN reads THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM e)
      SELECT CAST(w.user_id % 4 AS VARCHAR) AS part, w.pos * 2 AS pos, CASE WHEN p.pos IS NULL OR p.event_type = 'error' OR (p.event_type = 'signup' AND p.t + 3600000 <= w.t) THEN 'none'
        WHEN p.pos // 100 = w.pos // 100 THEN 'memory' WHEN p.event_type <> 'signup' AND w.asked > p.pos AND w.asked // 100 > p.pos // 100 THEN 'cache' ELSE 'file' END AS source
      FROM w LEFT JOIN e p ON p.pos = w.written WHERE w.reads""",
    "cache_trace": f"{CACHE} SELECT shard, pos, op, outcome, evicted FROM f WHERE rn > 0",
    "cache_counts": f"""{CACHE} SELECT shard, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (op = 'GET' AND outcome IN ('miss', 'expired')) AS misses, CAST(sum(evicted) AS BIGINT) AS evictions,
      count(*) FILTER (outcome = 'expired') AS expiries FROM f WHERE rn > 0 GROUP BY shard""",
    "stream_ingested": f"{O_LIVE} SELECT {COLUMNS} FROM live",
    "stream_claimed": f"SELECT key, pos, ts_ms, expires_at_ms FROM ({CLAIMS})",
    "raft_apply_prefix": f"""{RAFT}, u AS (SELECT idx, max(term) AS term, arg_max(data, term) AS data FROM e WHERE idx BETWEEN 1 AND 2000 GROUP BY idx), r AS (SELECT *, row_number() OVER (ORDER BY idx) AS rn FROM u)
      SELECT idx, term, data FROM r WHERE rn = idx""",
    "raft_apply_most": """WITH e AS (SELECT o_orderkey + 1 AS idx, CAST(1 AS BIGINT) AS term, o_orderstatus AS data, max(o_orderkey + 1) OVER () AS last FROM orders)
      SELECT idx, term, data FROM e WHERE idx < (SELECT min(idx) FROM e WHERE idx * 10 > last * 9 AND idx % 5 = 2)""",
    "raft_commit_index": f"""{RAFT}, m AS (SELECT n_nationkey * 60 + n_regionkey AS match_index FROM nation), q AS (SELECT match_index FROM m QUALIFY row_number() OVER (ORDER BY match_index DESC) = (SELECT count(*) FROM m) // 2 + 1)
      SELECT coalesce(max(idx), 0) AS commit_index FROM e, q WHERE term = 1 AND idx <= match_index""",
    "command_parse": f"""WITH {LINES}, p AS (SELECT pos, upper(split_part(line, ' ', 1)) AS h, len(string_split(line, ' ')) - 1 AS argc FROM lines)
      SELECT pos, CASE WHEN h = 'NONSENSE' THEN 'INVALID' ELSE h END AS op, CASE h WHEN 'GET' THEN 'string' WHEN 'SET' THEN 'string' WHEN 'INCRBY' THEN 'counter' WHEN 'LPUSH' THEN 'list' WHEN 'EXPIRE' THEN 'ttl' ELSE 'invalid' END AS kind, argc FROM p""",
    "command_replay": f"{REPLAY} SELECT part, pos, op, reply FROM r",
    "command_metrics": f"{REPLAY} SELECT op, count(*) AS requests, count(*) FILTER (starts_with(reply, '-ERR')) AS errors FROM r GROUP BY op",
    "crc32_check": f"""WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
      {OD}, k AS (SELECT seq, key || '|' || coalesce(value, '') AS s FROM od)
      SELECT seq, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)])), 4294967295) AS crc FROM k, tab""",
    "bloom_words": f"{BLOOM} SELECT file_number, n_bits, p // 32 AS word, bit_or(CAST(1 AS BIGINT) << CAST(p % 32 AS INT)) AS mask FROM b GROUP BY ALL",
    "bloom_probe": f"""{BLOOM}, asked AS (SELECT DISTINCT 'user:' || user_id AS key FROM events UNION SELECT DISTINCT 'none:' || user_id FROM events),
      q AS (SELECT file_number, key, unnest(list_transform(range(4), lambda i: ({H.format(k='key', at=1)} + i * {H.format(k='key', at=9)}) % n_bits)) AS p FROM asked, sized),
      d AS (SELECT DISTINCT file_number, p, true AS s FROM b)
      SELECT file_number, key, bool_and(coalesce(s, false)) AS maybe FROM q LEFT JOIN d USING (file_number, p) GROUP BY ALL""",
    "ttl_reclaim": f"WITH {EV}, {newest('ev', 'n')} SELECT {COLUMNS} FROM n WHERE type = 0 AND (expires_at_ms = 0 OR expires_at_ms > 1707000000000)",
    "ttl_purge_list": f"WITH {EV}, {newest('ev', 'n')} SELECT key, expires_at_ms FROM n WHERE type = 0 AND expires_at_ms <> 0 AND expires_at_ms <= 1707000000000",
    "raft_apply_commands": """WITH RECURSIVE e AS (SELECT event_id + 1 AS idx, 'user:' || user_id AS key, props AS value, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
        CASE event_type WHEN 'view' THEN 'S' WHEN 'click' THEN 'T' WHEN 'purchase' THEN 'E' WHEN 'error' THEN 'D' END AS op FROM events WHERE event_type <> 'signup'),
      f(key, rn, idx, op, v, x, wrote) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), false FROM e
        UNION ALL SELECT e.key, e.rn, e.idx, e.op, CASE e.op WHEN 'D' THEN NULL WHEN 'E' THEN f.v ELSE e.value END,
          CASE WHEN e.op = 'T' OR (e.op = 'E' AND f.v IS NOT NULL AND NOT (f.x > 0 AND f.x <= e.t)) THEN e.t + 3600000 WHEN e.op = 'E' THEN f.x ELSE 0 END,
          e.op <> 'E' OR (f.v IS NOT NULL AND NOT (f.x > 0 AND f.x <= e.t)) FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)
      SELECT key, idx AS seq, CASE WHEN op = 'D' THEN 1 ELSE 0 END AS type, v AS value, x AS expires_at_ms FROM f WHERE wrote""",
    "manifest_dump": f"{RUNS} SELECT file_number, level, lower(hex(smallest)) AS smallest, lower(hex(largest)) AS largest, max_seq FROM files",
    "key_sets_union": """SELECT o_orderkey + 1 AS txn, 'cust:' || o_custkey AS key FROM orders UNION SELECT o_orderkey + 1, 'cust:' || o_custkey || '#' FROM orders WHERE (o_orderkey + 1) % 3 = 0""",
}
