"""Text commands: splitting, classification, and the ordered replay of a log of lines.

A replay works on the whole keyspace of a partition in order, as commands may name several keys; give
each independent keyspace its own `part`. Replies are those of the wire protocol, byte for byte, but
for GET of a hash or list, whose stored encoding is no text: it gives the text (encoded).
"""

from __future__ import annotations

import bisect
import re
from collections import deque
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ring import Node, Ring
from ..schema import MAX_INT64, MIN_INT64
from .folds import parse_counter, stream_fold

#: The commands and the type each belongs to.
KINDS = {
    "connection": "PING AUTH QUIT", "string": "GET SET DEL MGET SCAN", "ttl": "EXPIRE PEXPIRE TTL PTTL PERSIST", "counter": "INCR INCRBY DECR DECRBY",
    "hash": "HSET HGET HDEL HEXISTS HLEN HGETALL HKEYS HVALS", "list": "LPUSH RPUSH LPOP RPOP LLEN LINDEX LRANGE", "txn": "BEGIN EXEC ABORT", "admin": "INFO STATS CLUSTER",
}
KIND_OF = {c: k for k, names in KINDS.items() for c in names.split()}

#: What commands say is wrong; {} stands for the name that is meant.
FAULTS = {
    "encoding": "Corruption: {} encoding corrupted", "ttl": "InvalidArgument: ttl is too large", "syntax": "syntax error", "expire": "invalid expire time in 'SET'",
    "duration": "invalid TTL value for '{}'", "integer": "invalid integer value for '{}'", "overflow": "InvalidArgument: counter overflow",
    "number": "InvalidArgument: value is not an integer", "limit": "invalid LIMIT value for 'SCAN'", "unknown": "unknown command", "leader": "not leader",
    "arity": "wrong number of arguments for {}", "in txn": "unsupported command in transaction", "options": "SET options are not supported in transactions",
    "login": "NOAUTH authentication required", "no password": "AUTH is not enabled", "password": "invalid password", "active": "transaction already active",
    "none active": "no active transaction", "conflict": "transaction conflict",
}


def parse(lines: DataFrame) -> DataFrame:
    """Adds tokens, op (upper case; INVALID if unknown or empty), kind and argc to lines(…, line)."""
    tokens = F.filter(F.split(F.regexp_replace("line", "\r$", ""), r"\s+"), lambda t: t != "")
    head = F.upper(F.coalesce(F.get("tokens", F.lit(0)), F.lit("")))
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    return (
        lines.withColumn("tokens", tokens).withColumn("kind", F.coalesce(F.try_element_at(kinds, head), F.lit("invalid")))
        .withColumn("op", F.when(F.col("kind") == "invalid", "INVALID").otherwise(head)).withColumn("argc", F.greatest(F.size("tokens") - 1, F.lit(0)))
    )


def metrics(replies: DataFrame) -> DataFrame:
    """Requests and errors by command."""
    return replies.groupBy("op").agg(F.count("*").alias("requests"), F.count_if(F.col("reply").startswith("-ERR")).alias("errors"))


def _int(text: str) -> int | None:
    value = int(text) if re.fullmatch(r"-?[0-9]+", text) else None
    return value if value is not None and MIN_INT64 <= value <= MAX_INT64 else None


class Keyspace:
    """Live keys with values and expiries; every write but expiry changes clears the expiry. Hashes and lists are
    changed in place and put again. While readers need an older state, what a write replaces is remembered."""

    def __init__(self):
        self.data: dict[str, tuple[object, int]] = {}
        self.order: list[str] = []
        self.clock = 0
        self.changed: dict[str, int] = {}  # key -> when it was last written
        self.readers: list[int] = []  # the times that open transactions began
        self.past: dict[str, list[tuple[int, tuple[object, int] | None]]] = {}  # key -> (when, what was there before)

    def get(self, key: str, now: int):
        found = self.data.get(key)
        return None if found is None or found[1] and found[1] <= now else found[0]

    def _change(self, key: str) -> None:
        self.clock += 1
        self.changed[key] = self.clock
        if self.readers:
            self.past.setdefault(key, []).append((self.clock, self.data.get(key)))

    def put(self, key: str, value, expires: int = 0) -> None:
        self._change(key)
        if key not in self.data:
            bisect.insort(self.order, key, key=str.encode)
        self.data[key] = (value, expires)

    def drop(self, key: str) -> None:
        self._change(key)
        if self.data.pop(key, None) is not None:
            del self.order[bisect.bisect_left(self.order, key.encode(), key=str.encode)]

    def then(self, key: str, start: int, now: int):
        """The value as of a time at which a reader began."""
        found = next((old for when, old in self.past.get(key, ()) if when > start), self.data.get(key)) if self.changed.get(key, 0) > start else self.data.get(key)
        return None if found is None or found[1] and found[1] <= now else found[0]

    def begin(self) -> int:
        self.readers.append(self.clock)
        return self.clock

    def end(self, start: int) -> None:
        self.readers.remove(start)
        if not self.readers:
            self.past.clear()


class Fail(Exception):
    pass


def simple(text: str) -> str:
    return f"+{text}\r\n"


def integer(n: int) -> str:
    return f":{n}\r\n"


def error(text: str) -> str:
    return f"-ERR{text}\r\n"


def bulk(text: str | None) -> str:
    return "$-1\r\n" if text is None else f"${len(text.encode())}\r\n{text}\r\n"


def array(items: list[str | None]) -> str:
    return f"*{len(items)}\r\n" + "".join(map(bulk, items))


def _typed(space: Keyspace, key: str, now: int, kind: type, name: str):
    value = space.get(key, now)
    if value is not None and not isinstance(value, kind):
        raise Fail(FAULTS["encoding"].format(name))
    return value


def _text(value) -> str | None:
    """What GET shows of a value: only texts are shown as they are."""
    return value if value is None or isinstance(value, str) else "(encoded)"


def _expiry(now: int, ms: int) -> int:
    if now + ms > MAX_INT64:
        raise Fail(FAULTS["ttl"])
    return now + ms


def _set(space: Keyspace, args: list[str], now: int) -> str:
    key, value, rest = args[0], args[1], [a.upper() for a in args[2:]]
    absent, ttl, at = False, None, 0
    while at < len(rest):
        if rest[at] == "NX" and not absent:
            absent, at = True, at + 1
            continue
        if rest[at] not in ("EX", "PX") or ttl is not None or at + 1 == len(rest):
            raise Fail(FAULTS["syntax"])
        ttl = _int(rest[at + 1])
        if ttl is None or ttl <= 0:
            raise Fail(FAULTS["expire"])
        if rest[at] == "EX":
            if ttl > MAX_INT64 // 1000:
                raise Fail(FAULTS["ttl"])
            ttl *= 1000
        at += 2
    if absent and space.get(key, now) is not None:
        return bulk(None)
    space.put(key, value, _expiry(now, ttl) if ttl else 0)
    return simple("OK")


def _ttl(space: Keyspace, op: str, args: list[str], now: int) -> str:
    key, value = args[0], space.get(args[0], now)
    if op in ("TTL", "PTTL"):
        if value is None:
            return integer(-2)
        expires = space.data[key][1]
        return integer(-1 if not expires else expires - now if op == "PTTL" else (expires - now) // 1000)
    if op == "PERSIST":
        if value is not None and space.data[key][1]:
            space.put(key, value)
        return integer(int(value is not None))
    n = _int(args[1])
    if n is None:
        raise Fail(FAULTS["duration"].format(op))
    if op == "EXPIRE" and n > MAX_INT64 // 1000:
        raise Fail(FAULTS["ttl"])
    if value is None:
        return integer(0)
    if n <= 0:
        space.drop(key)
    else:
        space.put(key, value, _expiry(now, n * 1000 if op == "EXPIRE" else n))
    return integer(1)


def _counter(space: Keyspace, op: str, args: list[str], now: int) -> str:
    by = 1 if op in ("INCR", "DECR") else _int(args[1])
    if by is None:
        raise Fail(FAULTS["integer"].format(op))
    old = space.get(args[0], now)
    value = 0 if old is None else parse_counter(old) if isinstance(old, str) else None
    if op == "DECRBY" and by == MIN_INT64:
        raise Fail(FAULTS["overflow"])
    if value is None:
        raise Fail(FAULTS["number"])
    value += -by if op.startswith("DECR") else by
    if not MIN_INT64 <= value <= MAX_INT64:
        raise Fail(FAULTS["overflow"])
    space.put(args[0], str(value))
    return integer(value)


def _hash(space: Keyspace, op: str, args: list[str], now: int) -> str:
    key, held = args[0], _typed(space, args[0], now, dict, "hash")
    held = {} if held is None else held
    there = args[1] in held if len(args) > 1 else False
    if op == "HSET":
        held[args[1]] = args[2]
        space.put(key, held)
        return integer(int(not there))
    if op == "HDEL":
        if there:
            del held[args[1]]
            space.put(key, held) if held else space.drop(key)
        return integer(int(there))
    if op == "HGET":
        return bulk(held.get(args[1]))
    if op in ("HEXISTS", "HLEN"):
        return integer(int(args[1] in held) if op == "HEXISTS" else len(held))
    names = sorted(held, key=str.encode)
    return array([x for f in names for x in ((f, held[f]) if op == "HGETALL" else (f,) if op == "HKEYS" else (held[f],))])


def _list(space: Keyspace, op: str, args: list[str], now: int) -> str:
    places = [_int(a) for a in args[1:]] if op in ("LINDEX", "LRANGE") else []
    if None in places:
        raise Fail(FAULTS["integer"].format(op))
    key, held = args[0], _typed(space, args[0], now, deque, "list")
    held = deque() if held is None else held
    if op in ("LPUSH", "RPUSH"):
        held.appendleft(args[1]) if op == "LPUSH" else held.append(args[1])
        space.put(key, held)
        return integer(len(held))
    if op in ("LPOP", "RPOP"):
        if not held:
            return bulk(None)
        out = held.popleft() if op == "LPOP" else held.pop()
        space.put(key, held) if held else space.drop(key)
        return bulk(out)
    if op == "LLEN":
        return integer(len(held))
    places = [p + len(held) if p < 0 else p for p in places]
    if op == "LINDEX":
        return bulk(held[places[0]] if 0 <= places[0] < len(held) else None)
    return array(list(islice(held, max(places[0], 0), max(places[1] + 1, 0))))


def _scan(space: Keyspace, args: list[str], now: int) -> str:
    """A first argument that begins with L is never a key; what follows a limit is not looked at."""
    start, limit, clause = "", 100, args
    if args and args[0][:1] not in ("l", "L"):
        start, clause = args[0], args[1:]
    if len(clause) > 1 and clause[0].upper() == "LIMIT":
        limit = _int(clause[1].removeprefix("+"))
        if limit is None or limit <= 0:
            raise Fail(FAULTS["limit"])
    out: list[str | None] = []
    for key in space.order[bisect.bisect_left(space.order, start.encode(), key=str.encode) :]:
        value = space.get(key, now)
        if value is not None:
            out += [key, _text(value)]
            if len(out) == 2 * limit:
                break
    return array(out)


#: How many arguments each command takes (none: at least that many), and the names that
#: errors give to families of commands.
ARITY = {
    **dict.fromkeys("PING".split(), (0, 0)), **dict.fromkeys("SCAN".split(), (0, None)), **dict.fromkeys("SET".split(), (2, None)), **dict.fromkeys("MGET".split(), (1, None)),
    **dict.fromkeys("GET DEL TTL PTTL PERSIST INCR DECR HLEN HGETALL HKEYS HVALS LPOP RPOP LLEN".split(), (1, 1)),
    **dict.fromkeys("EXPIRE PEXPIRE INCRBY DECRBY HGET HDEL HEXISTS LPUSH RPUSH LINDEX".split(), (2, 2)), **dict.fromkeys("HSET LRANGE".split(), (3, 3)),
}
FAMILY = {
    **dict.fromkeys("INCR INCRBY DECR DECRBY".split(), "counter command"), **dict.fromkeys("HKEYS HVALS".split(), "hash collection command"),
    **dict.fromkeys("LPUSH RPUSH".split(), "list push command"), **dict.fromkeys("LPOP RPOP".split(), "list pop command"),
}


def arity_fault(op: str, n: int) -> str | None:
    least, most = ARITY[op]
    return None if least <= n and (most is None or n <= most) else FAULTS["arity"].format(FAMILY.get(op, repr(op)))


def execute(space: Keyspace, op: str, args: list[str], now: int) -> str:
    if op not in ARITY:
        return error(FAULTS["unknown"])
    try:
        if fault := arity_fault(op, len(args)):
            raise Fail(fault)
        if op == "PING":
            return simple("PONG")
        if op == "GET":
            return bulk(_text(space.get(args[0], now)))
        if op == "SET":
            return _set(space, args, now)
        if op == "DEL":
            space.drop(args[0])
            return simple("OK")
        if op == "MGET":
            return array([_text(space.get(a, now)) for a in args])
        if op == "SCAN":
            return _scan(space, args, now)
        return {"counter": _counter, "ttl": _ttl, "hash": _hash, "list": _list}[KIND_OF[op]](space, op, args, now)
    except Fail as e:
        return error(str(e))


#: The names in the text of INFO and STATS, in order.
STATS = """cache.hit cache.miss cache.evict cache.expire read.table_cache_hits read.table_cache_misses read.table_cache_evictions read.table_cache_entries
read.bloom_queries read.bloom_negatives read.range_prunes compaction.trigger_attempts compaction.skipped_due_snapshot compaction.skipped_due_threshold
compaction.succeeded compaction.failed compaction.input_bytes compaction.output_bytes compaction.duration_us""".split()
#: What the admin commands say is wrong.
ADMIN_FAULTS = {
    "stats": "wrong number of arguments for 'INFO/STATS'", "cluster": "wrong number of arguments for 'CLUSTER'", "none": "cluster manager is null", "unknown": "unknown cluster command",
    "ROUTE": "wrong number of arguments for 'CLUSTER ROUTE'", "STATUS": "wrong number of arguments for 'CLUSTER STATUS'", "BATCH": "wrong number of arguments for 'CLUSTER BATCH'",
    "PLAN": "wrong number of arguments for 'CLUSTER PLAN'", "replicas": "invalid replica count for 'CLUSTER ROUTE'", "route": "no route available", "node": "node not found",
    "SET": "wrong number of arguments for 'CLUSTER BATCH SET'", "DEL": "wrong number of arguments for 'CLUSTER BATCH DEL'", "op": "unsupported operation for 'CLUSTER BATCH'",
    "local": "cluster local node id is not configured", "many": "cluster batch routes to multiple nodes", "remote": "cluster batch routes to a remote node",
    "txn": "cluster batch is not supported in transaction",
}


def node_line(n: Node) -> str:
    return f"id={n.id} address={n.host}:{n.port} weight={n.weight} alive={int(n.alive)}"


def rows(items: list[str]) -> str:
    """An array of replies that are encoded already."""
    return f"*{len(items)}\r\n" + "".join(items)


def stats(counts: dict[str, int] | None = None) -> str:
    """The text of INFO and STATS. Names without a count are 0: a replay keeps all in memory, without files and caches."""
    return bulk("\n".join(f"{name}={(counts or {}).get(name, 0)}" for name in STATS))


def _batch_ops(args: list[str]) -> list[tuple[str, str, str | None]]:
    out, at = [], 0
    while at < len(args):
        op = args[at].upper()
        if op not in ("SET", "DEL"):
            raise Fail(ADMIN_FAULTS["op"])
        n = 3 if op == "SET" else 2
        if at + n > len(args):
            raise Fail(ADMIN_FAULTS[op])
        out.append((op, args[at + 1], args[at + 2] if op == "SET" else None))
        at += n
    return out


def cluster(space: Keyspace, args: list[str], ring: Ring | None, local: str) -> str:
    """CLUSTER ROUTE key [n], STATUS [id], PLAN and BATCH of SET and DEL operations."""
    if not args:
        raise Fail(ADMIN_FAULTS["cluster"])
    if ring is None:
        raise Fail(ADMIN_FAULTS["none"])
    op, rest = args[0].upper(), args[1:]
    least, most = {"ROUTE": (1, 2), "STATUS": (0, 1), "BATCH": (1, None), "PLAN": (1, None)}.get(op, (0, None))
    if len(rest) < least or most is not None and len(rest) > most:
        raise Fail(ADMIN_FAULTS[op])
    if op == "ROUTE":
        n = int(rest[1]) if len(rest) == 2 and re.fullmatch(r"[0-9]{1,18}", rest[1]) else 1 if len(rest) == 1 else 0
        if not n:
            raise Fail(ADMIN_FAULTS["replicas"])
        found = ring.route(rest[0], n)
        if not found:
            raise Fail(ADMIN_FAULTS["route"])
        return array([node_line(ring.nodes[i]) for i in found])
    if op == "STATUS":
        if rest:
            if rest[0] not in ring.nodes:
                raise Fail(ADMIN_FAULTS["node"])
            return bulk(node_line(ring.nodes[rest[0]]))
        lines = [f"cluster.node_count={len(ring.nodes)}", f"cluster.active_node_count={sum(n.alive for n in ring.nodes.values())}"]
        return bulk("\n".join(lines + [f"node[{k}].{node_line(n)}" for k, n in enumerate(ring.nodes.values())]))
    if op not in ("BATCH", "PLAN"):
        raise Fail(ADMIN_FAULTS["unknown"])
    ops = _batch_ops(rest)
    if op == "BATCH" and not local:
        raise Fail(ADMIN_FAULTS["local"])
    groups: dict[str, list[tuple[str, str, str | None]]] = {}
    for x in ops:
        owner = ring.route(x[1])
        if not owner:
            raise Fail(ADMIN_FAULTS["route"])
        groups.setdefault(owner[0], []).append(x)
    if op == "PLAN":
        fields = lambda n: array([n.id, n.host, str(n.port), str(n.weight), str(int(n.alive))])
        return rows([rows([fields(ring.nodes[i]), rows([array(list(x)) for x in own])]) for i, own in groups.items()])
    if len(groups) != 1:
        raise Fail(ADMIN_FAULTS["many"])
    if local not in groups:
        raise Fail(ADMIN_FAULTS["remote"])
    for kind, key, value in ops:
        space.put(key, value) if kind == "SET" else space.drop(key)
    return simple("OK")


def admin(space: Keyspace, op: str, args: list[str], ring: Ring | None, local: str) -> str:
    try:
        if op == "CLUSTER":
            return cluster(space, args, ring, local)
        if args:
            raise Fail(ADMIN_FAULTS["stats"])
        return stats()
    except Fail as e:
        return error(str(e))


#: The commands that only a leader takes.
LEADS = "SET DEL EXPIRE PEXPIRE PERSIST INCR INCRBY DECR DECRBY HSET HDEL LPUSH RPUSH LPOP RPOP BEGIN EXEC ABORT".split()


def moved(address: str) -> str:
    return f"-MOVED {address}\r\n" if address else error(FAULTS["leader"])


IN_TXN = ("GET", "SET", "DEL", "MGET", "SCAN", "PING")


def replay(lines: DataFrame, password: str | None = None, nodes: list[tuple] | None = None, local: str = "", virtual: int = 8, leader: str | None = None) -> DataFrame:
    """part, pos, op, reply of lines(part, pos, ts_ms, session, line), replayed in order within a part.

    Sessions may BEGIN: reads then see the state at that time and the session's own writes, writes wait
    for EXEC, which fails if a key that was read or written has changed since. A transaction takes SET
    with two arguments only, and SCAN does not see its writes. With a password a session must AUTH first.
    CLUSTER answers from nodes (id, host, port, weight, alive), of which `local` executes batches. With a leader, this is a
    follower that sends writes there (to nobody, if the leader is '' for unknown)."""

    def begin():
        space = Keyspace()
        ring = None if nodes is None else Ring([Node(*n) for n in nodes], virtual)
        sessions: dict[str, dict] = {}

        def in_txn(own: dict, op: str, args: list[str], now: int) -> str:
            if op in ("INFO", "STATS", "CLUSTER"):
                if args and op == "CLUSTER" and args[0].upper() == "BATCH":
                    return error(ADMIN_FAULTS["txn"])
                return admin(space, op, args, ring, local)
            if op not in IN_TXN:
                return error(FAULTS["in txn"])
            if op == "SET" and len(args) != 2:
                return error(FAULTS["options"])
            if fault := arity_fault(op, len(args)):
                return error(fault)
            if op in ("SET", "DEL"):
                own["writes"][args[0]] = args[1] if op == "SET" else None
                return simple("OK")
            if op in ("GET", "MGET"):
                out = []
                for k in args:
                    if k not in own["writes"]:
                        own["reads"].add(k)
                    out.append(own["writes"][k] if k in own["writes"] else _text(space.then(k, own["start"], now)))
                return bulk(out[0]) if op == "GET" else array(out)
            return execute(space, op, args, now)

        def step(row):
            if row is None:
                return []
            tokens, now = (row["line"] or "").split(), row["ts_ms"]
            op, args = (tokens[0].upper(), tokens[1:]) if tokens else ("INVALID", [])
            op = op if op in KIND_OF else "INVALID"
            own = sessions.setdefault(row["session"], {"in": not password, "txn": None})
            txn = own["txn"]
            if op == "AUTH":
                fault = FAULTS["arity"].format("'AUTH'") if len(args) != 1 else FAULTS["no password"] if not password else FAULTS["password"] if args[0] != password else None
                own["in"] = own["in"] or not fault
                reply = error(fault) if fault else simple("OK")
            elif not own["in"]:
                reply = error(FAULTS["login"])
            elif leader is not None and op in LEADS:
                reply = moved(leader)
            elif op in ("BEGIN", "EXEC", "ABORT"):
                reply = simple("OK")
                if args:
                    reply = error(FAULTS["arity"].format(repr(op)))
                elif op == "BEGIN" and txn:
                    reply = error(FAULTS["active"])
                elif op == "BEGIN":
                    own["txn"] = {"start": space.begin(), "writes": {}, "reads": set()}
                elif not txn:
                    reply = error(FAULTS["none active"])
                else:
                    own["txn"] = None
                    space.end(txn["start"])
                    if op == "EXEC" and any(space.changed.get(k, 0) > txn["start"] for k in {*txn["reads"], *txn["writes"]}):
                        reply = error(FAULTS["conflict"])
                    elif op == "EXEC":
                        for k, v in txn["writes"].items():
                            space.put(k, v) if v is not None else space.drop(k)
            elif txn:
                reply = in_txn(txn, op, args, now)
            elif op in ("INFO", "STATS", "CLUSTER"):
                reply = admin(space, op, args, ring, local)
            else:
                reply = error(FAULTS["unknown"]) if op == "INVALID" else execute(space, op, args, now)
            return [(row["part"], row["pos"], op, reply)]

        return step

    return stream_fold(lines, "part", ["pos"], begin, "part string, pos long, op string, reply string")
