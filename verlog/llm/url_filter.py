"""URL filters: host and path rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models, one of accepted and one of rejected urls, are counted over all
labelled urls. The probability of a character mixes the counts of its longest known context with
those of ever shorter ones. A url's score is the mean log-likelihood difference per character; the
threshold is calibrated on a fifth of the labelled urls that the models never saw.

Contexts are hashed to a table of fixed size, so a model has the same bound at any input size.

Defined cases: a null url, or one without ://, has an empty host and path and no rule; it is scored
as an empty text. With urls of one class only, every url without a rule gets that class's verdict;
with none, 'allow'. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS, BITS, BINS, SPAN = 5, 18, 1024, 8.0
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of (verdict, 'host/path') pairs, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _windows(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all characters of the texts: slots of character-in-context, slots of context by order, owner."""
    pad = b"\x02" * ORDERS
    blobs = [pad + t.encode() + b"\x03" for t in texts]
    flat = np.frombuffer(b"".join(blobs), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(b) for b in blobs])
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    real = np.ones(len(flat), dtype=bool)
    for k in range(ORDERS):
        real[start + k] = False
    at = np.flatnonzero(real)
    owner = np.repeat(np.arange(len(texts)), sizes - ORDERS)
    context, joint, plain = np.zeros(len(at), np.uint64), [], []
    for k in range(ORDERS + 1):
        if k:
            context = (context + flat[at - k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(29)
        both = (context + flat[at] + np.uint64(k * 1000 + 7)) * np.uint64(0xBF58476D1CE4E5B9)
        only = (context + np.uint64(k * 1000 + 3)) * np.uint64(0x94D049BB133111EB)
        shift = np.uint64(64 - BITS)
        joint.append((both >> shift).astype(np.int64) + (k << BITS))
        plain.append((only >> shift).astype(np.int64) + (k << BITS))
    return joint, plain, owner


def count_contexts(labelled: DataFrame) -> dict[bool, np.ndarray]:
    """Counts by slot of accepted and rejected urls, over all rows of labelled(text, accepted)."""
    size = (ORDERS + 1) << BITS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {c: np.zeros(2 * size, np.int64) for c in (False, True)}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                accepted = np.array(part.column("accepted").to_pylist(), dtype=bool)
                urls = part.column("text").to_pylist()
                for c in (False, True):
                    own = [u for u, a in zip(urls, accepted, strict=True) if a == c]
                    if own:
                        joint, plain, _ = _windows(own)
                        for shift, slots in ((0, joint), (size, plain)):
                            for k, s in enumerate(slots):  # those of an order lie together
                                at_order = shift + (k << BITS)
                                counts[c][at_order : at_order + (1 << BITS)] += np.bincount(s - (k << BITS), minlength=1 << BITS)
        for c, n in counts.items():
            for some in np.array_split(np.flatnonzero(n), 1 + len(np.flatnonzero(n)) // 50_000):
                yield pa.RecordBatch.from_pydict({"accepted": pa.array([c] * len(some), pa.bool_()), "slot": pa.array(some), "n": pa.array(n[some])})

    found = labelled.mapInArrow(task, "accepted boolean, slot long, n long").groupBy("accepted", "slot").agg(F.sum("n").alias("n"))
    out = {c: np.zeros(2 * size, np.float32) for c in (False, True)}
    table = found.toArrow()  # at most four tables of `size` slots
    label = np.array(table["accepted"].to_pylist(), dtype=bool)
    slot, n = table["slot"].to_numpy(), table["n"].to_numpy()
    for c in out:
        out[c][slot[label == c]] = n[label == c]
    return out


def log_likelihoods(counts: np.ndarray, joint: list[np.ndarray], plain: list[np.ndarray], weight: float = 4.0) -> np.ndarray:
    """ln p of each character: the counts of order k, with `weight` characters dealt as order k-1 says."""
    size = (ORDERS + 1) << BITS
    p = np.full(len(joint[0]), 1 / 256)
    for k in range(ORDERS + 1):
        own = counts[plain[k] + size]
        p = (np.minimum(counts[joint[k]], own) + weight * p) / (own + weight)  # slots may be shared, but p is at most 1
    return np.log(p)


def score_urls(df: DataFrame, counts: dict[bool, np.ndarray]) -> DataFrame:
    """Adds score: the mean difference of log-likelihoods of text, accepted minus rejected."""
    models = df.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                joint, plain, owner = _windows(part.column("text").to_pylist())
                gain = log_likelihoods(models.value[True], joint, plain) - log_likelihoods(models.value[False], joint, plain)
                score = np.bincount(owner, gain, part.num_rows) / np.bincount(owner, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    return df.mapInArrow(task, f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, score double")


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best mean of both classes' accuracies on scored(score, accepted)."""
    bin_of = F.least(F.greatest(F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1))
    bad, good = np.zeros(BINS), np.zeros(BINS)
    for b, accepted, n in scored.groupBy(bin_of.alias("b"), "accepted").count().collect():
        (good if accepted else bad)[b] += n
    if not good.sum() or not bad.sum():
        return 0.0
    below = lambda n: np.concatenate(([0], np.cumsum(n)))
    merit = below(bad) / bad.sum() + 1 - below(good) / good.sum()
    best = np.flatnonzero(merit >= merit.max() - 1e-12)
    return float(best[len(best) // 2]) * (2 * SPAN / BINS) - SPAN


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row; rules are (verdict, rule)."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    parts = urls.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parts.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("rule")).withColumn("text", F.concat("host", "path"))
    allowed = [r for v, r in rules if v == "allow"]
    known = ruled.where("rule is not null").select("text", F.col("rule").isin(allowed).alias("accepted"))
    held = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(FOLDS)) == 0
    counts = count_contexts(known.where(~held))
    classes = [c for c in (False, True) if counts[c].any()]
    if len(classes) == 2:
        cut = calibrate(score_urls(known.where(held), counts))
    else:
        cut = -np.inf if classes != [False] else np.inf
    own = F.when(F.col("rule").isin(allowed), "allow").when(F.col("rule").isNotNull(), "block")
    return score_urls(ruled, counts).select(
        "page_id", "host", "path", "rule",
        F.coalesce(own, F.when(F.col("score") >= F.lit(float(cut)), "allow").otherwise("block")).alias("verdict"), "score",
    )

