"""Consistent-hash routing: tokens of virtual nodes, the owner and replicas of a key, batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Options
from ..functions.collections import fnv, fnv_halves
from ..functions.ring import MAX_TOKENS, Node, Ring

LEAD_BITS = 12


def check_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes that may join: an id, a host and a port."""
    return nodes.where("id <> '' and host <> '' and port > 0")


def membership(events: DataFrame) -> DataFrame:
    """The nodes after events(pos, action, id, host, port, weight, alive): ADD replaces a node of the same id, unless
    it is invalid; REMOVE takes it out; ALIVE and DEAD change a node that is there."""
    sound = (F.col("action") == "REMOVE") | (F.col("action") == "ADD") & (F.col("id") != "") & (F.col("host") != "") & (F.col("port") > 0)
    flips = F.col("action").isin("ALIVE", "DEAD")
    last = events.where("id is not null").groupBy("id").agg(
        F.max_by(F.struct("action", "host", "port", "weight", "alive"), F.when(sound, F.col("pos"))).alias("n"), F.max(F.when(sound, F.col("pos"))).alias("at"),
        F.max_by("action", F.when(flips, F.col("pos"))).alias("flip"), F.max(F.when(flips, F.col("pos"))).alias("flipped"),
    )
    there = last.where("n.action = 'ADD'")
    alive = F.when(F.col("flipped") > F.col("at"), F.col("flip") == "ALIVE").otherwise(F.col("n.alive"))
    return there.select("id", "n.host", "n.port", "n.weight", alive.alias("alive"))


def ring_of(nodes: DataFrame, virtual: int = Options.virtual_nodes) -> Ring:
    """The ring of a table of nodes. It is small: a row for each node, and their tokens are checked."""
    rows = check_nodes(nodes).select("id", "host", "port", "weight", "alive").limit(MAX_TOKENS + 1).collect()
    if len(rows) > MAX_TOKENS:
        raise ValueError("too many nodes")
    return Ring([Node(*r) for r in rows], virtual)


def tokens(nodes: DataFrame, virtual: int) -> DataFrame:
    """(id, i, token) of the living nodes: `virtual` for each unit of weight, weight 0 counting as 1. A token that
    is taken already moves up."""
    rows = [(n, i, str(t)) for n, i, t in ring_of(nodes, virtual).rows]
    return nodes.sparkSession.createDataFrame(rows, "id string, i int, token string").withColumn("token", F.col("token").cast("decimal(20,0)"))


def _owned(keys: DataFrame, nodes: DataFrame, n: int, virtual: int) -> DataFrame:
    """keys with hash and owners, the first n nodes from the hash on (null on an empty ring): a join by the hash's
    leading bits with the spans between tokens, of which there are at most MAX_TOKENS and one for each value of the bits."""
    spans = ring_of(nodes, virtual).spans(n, LEAD_BITS)
    table = nodes.sparkSession.createDataFrame([(b, str(lo), str(hi), o) for b, lo, hi, o in spans], "__lead int, __low string, __high string, owners array<string>")
    table = table.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("__low", "__high")})
    halves = fnv_halves(F.col("key"))
    hashed = keys.withColumn("__h", halves).withColumns({"hash": fnv(F.col("key")), "__lead": F.shiftright("__h.hi", 32 - LEAD_BITS).cast("int")}).drop("__h")
    return hashed.join(F.broadcast(table), ["__lead"], "left").where("owners is null or hash between __low and __high").drop("__lead", "__low", "__high")


def route(keys: DataFrame, nodes: DataFrame, virtual: int = Options.virtual_nodes) -> DataFrame:
    """keys(key, …) with hash and node: that of the first token at or after the hash, else the first of
    all; null on an empty ring."""
    return _owned(keys, nodes, 1, virtual).withColumn("node", F.get("owners", F.lit(0))).drop("owners")


def route_all(keys: DataFrame, nodes: DataFrame, virtual: int = Options.virtual_nodes) -> DataFrame:
    """route() of all keys, or no row if some key has no node."""
    if not ring_of(nodes, virtual).tokens:
        return route(keys, nodes, virtual).limit(0)
    return route(keys, nodes, virtual)


def replicas(keys: DataFrame, nodes: DataFrame, n: int, virtual: int = Options.virtual_nodes) -> DataFrame:
    """A row for each of the first n distinct nodes from the key's place on; rank from 0."""
    return _owned(keys, nodes, n, virtual).select("key", F.posexplode("owners").alias("rank", "node"))


def plan(ops: DataFrame, nodes: DataFrame, virtual: int = Options.virtual_nodes) -> DataFrame:
    """ops(pos, key, …) grouped by node: group (from 0, in the order of first operations) and the place of
    each operation in its group."""
    routed = route(ops, nodes, virtual)
    first = routed.groupBy("node").agg(F.min("pos").alias("first"))
    order = first.withColumn("grp", F.row_number().over(Window.orderBy("first")) - 1)  # a row for each node
    nth = F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1
    return routed.join(F.broadcast(order), "node").select("pos", "key", "node", "grp", nth.alias("nth"))


def single_node(ops: DataFrame, nodes: DataFrame, local: str, virtual: int = Options.virtual_nodes) -> DataFrame:
    """Of ops(batch, key): whether a batch goes to one node, and whether that is the local one."""
    routed = route(ops, nodes, virtual)
    return routed.groupBy("batch").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).select(
        "batch", (F.col("lo") == F.col("hi")).alias("single"), ((F.col("lo") == F.col("hi")) & (F.col("lo") == local)).alias("executable")
    )


def status(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count"), F.count_if("alive").alias("active_node_count"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
