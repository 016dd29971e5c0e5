import pytest

from verlog.operators import commands


def run(lines, now=0, space=None):
    space = space or commands.Keyspace()
    out = []
    for line in lines:
        t = line.split()
        out.append(commands.execute(space, t[0].upper(), t[1:], now))
    return out


def test_types_and_exact_replies():
    assert run(["INCR c", "INCRBY c 5", "DECRBY c 2", "HSET h b 2", "HSET h a 1", "HSET h b 3", "HGETALL h", "RPUSH l x", "LPUSH l w", "LRANGE l 0 -1", "LPOP l", "RPOP l", "RPOP l", "LLEN l"]) == [
        ":1\r\n", ":6\r\n", ":4\r\n", ":1\r\n", ":1\r\n", ":0\r\n", "*4\r\n$1\r\na\r\n$1\r\n1\r\n$1\r\nb\r\n$1\r\n3\r\n", ":1\r\n", ":2\r\n", "*2\r\n$1\r\nw\r\n$1\r\nx\r\n", "$1\r\nw\r\n", "$1\r\nx\r\n", "$-1\r\n", ":0\r\n",
    ]


@pytest.mark.parametrize("line", ["SET k v EX", "SET k v EX 0", "SET k v PX -1", "SET k v EX x", "SET k v EX 1 PX 1", "SET k v XX", "SET k v NX NX", "SET k v EX 9223372036854775807", "EXPIRE k x", "EXPIRE k 9223372036854775807", "PEXPIRE k"])
def test_malformed_expiries_leave_the_state(line):
    space = commands.Keyspace()
    run(["SET k original"], space=space)
    assert run([line], space=space)[0].startswith("-ERR")
    assert run(["GET k", "PTTL k"], space=space) == ["$8\r\noriginal\r\n", ":-1\r\n"]


def test_expiry_commands():
    space = commands.Keyspace()
    run(["SET a 1 PX 1999", "SET b 1"], now=0, space=space)
    assert run(["TTL a", "PTTL a", "TTL b", "TTL c", "PERSIST b", "PERSIST c", "EXPIRE b 0", "GET b", "SET a 2 NX"], now=1000, space=space) == [":0\r\n", ":999\r\n", ":-1\r\n", ":-2\r\n", ":1\r\n", ":0\r\n", ":1\r\n", "$-1\r\n", "$-1\r\n"]
    assert run(["GET a", "SET a 2 NX", "PTTL a"], now=1999, space=space) == ["$-1\r\n", "+OK\r\n", ":-1\r\n"]


def test_wrong_types_and_arity():
    space = commands.Keyspace()
    run(["SET s text", "RPUSH l 1"], space=space)
    assert run(["INCR s", "HSET s f v", "LPUSH s x", "INCR l", "GET", "LPOP", "INCRBY s", "LINDEX l x"], space=space) == [
        "-ERRInvalidArgument: value is not an integer\r\n", "-ERRCorruption: hash encoding corrupted\r\n", "-ERRCorruption: list encoding corrupted\r\n", "-ERRInvalidArgument: value is not an integer\r\n",
        "-ERRwrong number of arguments for 'GET'\r\n", "-ERRwrong number of arguments for list pop command\r\n", "-ERRwrong number of arguments for counter command\r\n", "-ERRinvalid integer value for 'LINDEX'\r\n",
    ]


def test_scan_clauses():
    space = commands.Keyspace()
    run([f"SET k{i} {i}" for i in range(5)], space=space)
    two = "*4\r\n$2\r\nk3\r\n$1\r\n3\r\n$2\r\nk4\r\n$1\r\n4\r\n"
    assert run(["SCAN k3", "SCAN k3 LIMIT 2 junk", "SCAN k3 LIMIT 0"], space=space) == [two, two, "-ERRinvalid LIMIT value for 'SCAN'\r\n"]
    assert run(["SCAN lemon"], space=space) == run(["SCAN"], space=space)
    assert run(["SCAN limit 1"], space=space) == ["*2\r\n$2\r\nk0\r\n$1\r\n0\r\n"]


def test_sessions_and_transactions(spark):
    lines = ["a|GET x", "a|AUTH no", "a|AUTH pw", "b|AUTH pw", "a|SET x 1", "a|BEGIN", "a|SET x 2", "a|GET x", "b|GET x", "a|INCR x", "a|SET x 1 NX", "b|SET x 9", "a|EXEC", "b|GET x", "b|BEGIN", "b|DEL x", "b|EXEC", "a|GET x", "a|EXEC", "a|what"]
    df = spark.createDataFrame([("p", i, 0, *x.split("|")) for i, x in enumerate(lines)], "part string, pos long, ts_ms long, session string, line string")
    got = [r.reply for r in commands.replay(df, "pw").orderBy("pos").collect()]
    ok, nil = "+OK\r\n", "$-1\r\n"
    assert got == [
        "-ERRNOAUTH authentication required\r\n", "-ERRinvalid password\r\n", ok, ok, ok, ok, ok, "$1\r\n2\r\n", "$1\r\n1\r\n", "-ERRunsupported command in transaction\r\n", "-ERRSET options are not supported in transactions\r\n",
        ok, "-ERRtransaction conflict\r\n", "$1\r\n9\r\n", ok, ok, ok, nil, "-ERRno active transaction\r\n", "-ERRunknown command\r\n",
    ]
    assert {r.op: (r.requests, r.errors) for r in commands.metrics(commands.replay(df, "pw")).collect()}["AUTH"] == (3, 1)


def test_parse(spark):
    df = spark.createDataFrame([("get  a\r",), ("",), ("nope x",), ("HSET a b c",)], "line string")
    assert [(r.op, r.kind, r.argc) for r in commands.parse(df).collect()] == [("GET", "string", 1), ("INVALID", "invalid", 0), ("INVALID", "invalid", 1), ("HSET", "hash", 3)]


def test_admin_commands_and_snapshots_of_sessions(spark):
    nodes = [("n1", "10.0.0.1", 1, 1, True), ("n2", "10.0.0.2", 2, 0, False)]
    lines = ["a|RPUSH l 1", "a|SET x 1", "a|BEGIN", "b|SET x 2", "b|RPUSH l 2", "a|GET x", "a|GET l", "a|CLUSTER STATUS", "a|ABORT", "a|GET x", "a|CLUSTER BATCH SET y 5 DEL x", "a|GET y", "a|GET x",
             "a|CLUSTER PLAN SET p 1 DEL q", "a|CLUSTER ROUTE k 9", "b|LRANGE l 0 -1", "b|LPOP l", "b|LINDEX l -1"]
    df = spark.createDataFrame([("p", i, 0, *x.split("|")) for i, x in enumerate(lines)], "part string, pos long, ts_ms long, session string, line string")
    got = [r.reply for r in commands.replay(df, nodes=nodes, local="n1").orderBy("pos").collect()]
    one, two = "id=n1 address=10.0.0.1:1 weight=1 alive=1", "id=n2 address=10.0.0.2:2 weight=0 alive=0"
    status = f"cluster.node_count=2\ncluster.active_node_count=1\nnode[0].{one}\nnode[1].{two}"
    node = "*5\r\n$2\r\nn1\r\n$8\r\n10.0.0.1\r\n$1\r\n1\r\n$1\r\n1\r\n$1\r\n1\r\n"
    plan = f"*1\r\n*2\r\n{node}*2\r\n*3\r\n$3\r\nSET\r\n$1\r\np\r\n$1\r\n1\r\n*3\r\n$3\r\nDEL\r\n$1\r\nq\r\n$-1\r\n"
    assert got[5:] == [
        "$1\r\n1\r\n", "$9\r\n(encoded)\r\n", commands.bulk(status), "+OK\r\n", "$1\r\n2\r\n", "+OK\r\n", "$1\r\n5\r\n", "$-1\r\n", plan, commands.array([one]), "*2\r\n$1\r\n1\r\n$1\r\n2\r\n", "$1\r\n1\r\n", "$1\r\n2\r\n",
    ]
    remote = [r.reply for r in commands.replay(df.where("line like '%BATCH%'"), nodes=nodes, local="n2").collect()]
    unset = [r.reply for r in commands.replay(df.where("line like '%BATCH%'"), nodes=nodes).collect()]
    assert remote == ["-ERRcluster batch routes to a remote node\r\n"] and unset == ["-ERRcluster local node id is not configured\r\n"]
