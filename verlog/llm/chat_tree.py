"""Chat formatting into a prefix tree of turns.

Conversations that share their initial turns share the nodes of those turns. All nodes are laid out
depth first in one token stream, each once; a node carries its start in the stream, the position id
of its first token (the tokens of its ancestors) and the intervals of the stream that its tokens may
attend to besides their own node. A node that directly follows its parent in the stream shares the parent's interval, so
the list grows with the branches that a path takes other than first, not with its depth. A conversation is the list of
its nodes.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`, where both markers are single control ids. A text is
escaped so that it holds no control string: `<`, n backslashes, `|` gets one backslash more. Roles
have backslashes and line ends escaped before that. Both are undone exactly. Only the text of an
assistant turn is under the loss mask.

The work is a pass that streams each conversation in turn order (a turn at a time, however many it
has), a range sort of the conversations by their path, which puts those with common beginnings next
to each other and is thereby the depth-first order, and prefix sums by partition. A node's first
conversation in that order owns it. First turns shared by a third of all conversations are reduced
by partial aggregation, and the joins on nodes are ones that adaptive execution splits.

Defined cases: null text or role is empty; texts of any length have the ids of the whole text; turns that tie are ordered by role, then text; repeated
rows are turns of their own; rows with a null conv_id are one conversation; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

START, END = "<|im_start|>", "<|im_end|>"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary splits text before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 50_000
BREAK = re.compile(r"(?<=[^\s\x85\xa0])[ \n]")
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Tokens:
    """Byte-level BPE of a public vocabulary, with one control id for each turn marker."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start, self.end = len(ranks), len(ranks) + 1

    def plain(self, text: str) -> list[int]:
        """The ids of a text. Long ones are cut after PIECE characters, before a blank that ends something else: there
        PATTERN splits in any case, so the ids are those of the whole text."""
        out: list[int] = []
        at = 0
        while at < len(text):
            found = BREAK.search(text, at + PIECE)
            end = found.start() if found else len(text)
            out += self.bpe.encode_ordinary(text[at:end])
            at = end
        return out

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """The ids of a turn, and which of them, from and to, are its text."""
        head = [self.start, *self.plain(escape_role(role) + "\n")]
        body = self.plain(escape(text))
        return [*head, *body, self.end, *self.plain("\n")], len(head), len(head) + len(body)

    def text(self, ids: list[int]) -> str:
        out, run = [], []
        for i in ids:
            if i in (self.start, self.end):
                out += [self.bpe.decode_bytes(run).decode(), START if i == self.start else END]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.bpe.decode_bytes(run).decode()])


@functools.lru_cache(2)
def tokens(vocabulary: str) -> Tokens:
    return Tokens(vocabulary)


def _stream(df: DataFrame, key: str, order: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows of each key in order, one at a time: make() gives a function of a row (None: the end of
    the key) that returns rows. No more than a batch of rows is held."""
    arrow = df.sparkSession.createDataFrame([], schema)
    fields = arrow.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(_arrow_fields(schema))
        step, last, out = None, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for row in batch.slice(at, 512).to_pylist():
                    if step is None or row[key] != last:
                        if step is not None:
                            out += step(None)
                        step, last = make(), row[key]
                    out += step(row)
                if out:
                    yield pa.RecordBatch.from_pydict({f: [r[i] for r in out] for i, f in enumerate(fields)}, schema=kind)
                    out = []
        if step is not None and (out := step(None)):
            yield pa.RecordBatch.from_pydict({f: [r[i] for r in out] for i, f in enumerate(fields)}, schema=kind)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(task, schema)


def _arrow_fields(schema: str) -> list[pa.Field]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return [pa.field(*(p[0], kinds[p[1]])) for p in (f.split(" ") for f in schema.split(", "))]


def _node(parent: bytes, role: str, text: str) -> bytes:
    h = hashlib.blake2b(parent, digest_size=16)
    for part in (role.encode(), text.encode()):
        h.update(len(part).to_bytes(8, "little") + part)
    return h.digest()


def build(conversations: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(nodes, members), both staged.

    nodes: node, depth, ids, loss_from, loss_to (which of ids are under the loss mask), n_ids, start,
    position, attends (from, to, from, to … in the stream). members: conv_id, idx, node.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )

    def chain() -> Callable:
        state = {"node": b"", "idx": 0}

        def step(row: dict | None) -> list[tuple]:
            if row is None:
                return []
            state["node"] = _node(state["node"], row["role"], row["text"])
            state["idx"] += 1
            return [(row["conv_id"], state["idx"], state["node"], row["role"], row["text"])]

        return step

    turns = stage(_stream(rows, "conv_id", ["turn", "role", "text"], chain, "conv_id long, idx int, node binary, role string, text string"), "turns")

    def path() -> Callable:
        state: dict = {"path": []}

        def step(row: dict | None) -> list[tuple]:
            if row is None:
                return [(state["conv"], state["path"])]
            state["conv"] = row["conv_id"]
            state["path"].append(int.from_bytes(row["node"][:8], "little", signed=True))
            return []

        return step

    paths = _stream(turns.select("conv_id", "idx", "node"), "conv_id", ["idx"], path, "conv_id long, path array<long>")
    order = stage(paths.orderBy("path", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("place")), "order")
    placed = turns.join(order, turns.conv_id.eqNullSafe(order.conv_id)).select(turns.conv_id, "idx", "node", "place", "role", "text")
    # a node belongs to the first conversation that has it
    owner = placed.groupBy("node").agg(F.min("place").alias("place"))
    owned = placed.join(owner, ["node", "place"]).select("node", "idx", "place", "role", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = [own.turn(r, t) for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
                learn = [r == LEARNED_ROLE for r in part.column("role").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("node"), part.column("idx"), part.column("place"), pa.array([d[0] for d in done], pa.list_(pa.int32())),
                    pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] if x else d[1] for d, x in zip(done, learn, strict=True)], pa.int32()),
                ], names=["node", "depth", "place", "ids", "loss_from", "loss_to"])

    laid = stage(
        owned.mapInArrow(encode, "node binary, depth int, place long, ids array<int>, loss_from int, loss_to int")
        .withColumn("n_ids", F.size("ids").cast("long")).repartitionByRange("place", "depth").withColumn("part", F.spark_partition_id()),
        "laid",
    )
    filled, before = 0, []  # a row for each partition
    for part, n in sorted(laid.groupBy("part").agg(F.sum("n_ids")).collect()):
        before.append((part, filled))
        filled += n
    sums = F.broadcast(laid.sparkSession.createDataFrame(before, "part int, before long"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("place", "depth").rowsBetween(Window.unboundedPreceding, -1))
    starts = stage(
        laid.select("node", "place", "depth", "n_ids", "part").withColumn("start", F.coalesce(within, F.lit(0))).join(sums, "part")
        .select("node", "place", "n_ids", (F.col("start") + F.col("before")).alias("start")),
        "starts",
    )
    members = turns.select("conv_id", "idx", "node")

    def attend() -> Callable:
        state: dict = {"position": 0, "spans": []}

        def step(row: dict | None) -> list[tuple]:
            if row is None:
                return []
            spans, out = state["spans"], []
            if row["place"] == row["own"]:
                out = [(row["node"], state["position"], list(spans))]
            if spans and spans[-1] == row["start"]:
                spans[-1] += row["n_ids"]
            else:
                spans += [row["start"], row["start"] + row["n_ids"]]
            state["position"] += row["n_ids"]
            return out

        return step

    whole = members.join(starts, "node").join(order.withColumnRenamed("place", "own").withColumnRenamed("conv_id", "by"), F.col("conv_id").eqNullSafe(F.col("by")))
    seen = _stream(whole.select("conv_id", "idx", "node", "place", "own", "start", "n_ids"), "conv_id", ["idx"], attend, "node binary, position long, attends array<long>")
    nodes = stage(
        laid.drop("place", "part").join(starts.select("node", "start"), "node").join(seen, "node"), "nodes",
    )
    return nodes, members


def read_back(nodes: DataFrame, members: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation,
    from the ids of its nodes alone."""

    def digest() -> Callable:
        own = tokens(vocabulary)
        state = {"turns": 0, "loss": 0, "chars": 0}
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def step(row: dict | None) -> list[tuple]:
            if row is None:
                return [(state["conv"], state["turns"], turns.hexdigest(), state["loss"], loss.hexdigest(), state["chars"])]
            formatted = own.text(row["ids"])
            found = re.fullmatch(r"(?s)<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", formatted)
            if not found:
                raise ValueError("a node that is no turn")
            masked = unescape(own.text(row["ids"][row["loss_from"] : row["loss_to"]]))
            turns.update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
            loss.update(masked.encode())
            state["conv"] = row["conv_id"]
            state["turns"] += 1
            state["loss"] += len(masked)
            state["chars"] += len(formatted)
            return []

        return step

    rows = members.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node")
    return _stream(
        rows.select("conv_id", "idx", "ids", "loss_from", "loss_to"), "conv_id", ["idx"], digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
