"""Bloom filters of files as frames of 32-bit words, so that building and probing stay distributed.

A key sets PROBES bits by double hashing of its digest, in a filter of bits_per_key bits for each
entry (every version counts). A filter says no only about keys that are not there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES, WORD = 4, 32
SHIFT = WORD.bit_length() - 1
BLOCK, FILES = 1024, 256  # keys in a row and files in a task when all files are asked for all keys
WIDEST = 1 << 22  # bits of the largest filter that is kept in one row; a task has four times as many


def _hash(key: Column, part: int) -> Column:
    """32 bits of the key's MD5 digest."""
    return F.conv(F.substr(F.md5(key.cast("binary")), F.lit(1 + 8 * part), F.lit(8)), 16, 10).cast("long")


def _probes(first: Column, second: Column, bits: Column) -> list[Column]:
    return [F.pmod(first + i * second, bits) for i in range(PROBES)]


def positions(key: Column, bits: Column) -> Column:
    return F.array(*_probes(_hash(key, 0), _hash(key, 1), bits))


def _sized(entries: DataFrame, bits_per_key: int) -> DataFrame:
    return entries.groupBy("file_number").agg((F.count("*") * (bits_per_key or 10)).alias("n_bits"))


def _bits(entries: DataFrame, sized: DataFrame) -> DataFrame:
    """file_number, n_bits, word, bit: the bits that the entries of the sized files set."""
    spread = entries.select("file_number", "key").distinct().join(sized, "file_number").select("file_number", "n_bits", F.explode(positions(F.col("key"), F.col("n_bits"))).alias("at"))
    bit = F.expr(f"shiftleft(1L, cast(at % {WORD} as int))")
    return spread.select("file_number", "n_bits", F.floor(F.col("at") / WORD).alias("word"), bit.alias("bit"))


def _masks(bits: DataFrame) -> DataFrame:
    return bits.groupBy("file_number", "n_bits", "word").agg(F.bit_or("bit").alias("mask"))


def build(entries: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """file_number, n_bits, word, mask of entries(file_number, key); 0 bits per key means 10."""
    return _masks(_bits(entries, _sized(entries, bits_per_key)))


def may_contain(filters: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(file_number, key) with maybe: false only if the file lacks the key."""
    sized = filters.select("file_number", "n_bits").distinct()
    probes = asked.join(sized, "file_number").select("file_number", "key", F.explode(positions(F.col("key"), F.col("n_bits"))).alias("at"))
    probes = probes.select("file_number", "key", F.floor(F.col("at") / WORD).alias("word"), F.expr(f"shiftleft(1L, cast(at % {WORD} as int))").alias("bit"))
    hit = probes.join(filters.select("file_number", "word", "mask"), ["file_number", "word"], "left").withColumn("set", F.coalesce(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.lit(False)))
    return hit.groupBy("file_number", "key").agg(F.bool_and("set").alias("maybe"))


def _whole(entries: DataFrame, sized: DataFrame) -> DataFrame:
    """file_number, n_bits, words: a row for each sized file, with the masks of all its words in order."""
    clear = F.explode(F.expr(f"sequence(0L, (n_bits - 1) div {WORD})"))
    bits = _bits(entries, sized).where("word is not null").unionByName(sized.select("file_number", "n_bits", clear.alias("word"), F.lit(0).cast("long").alias("bit")))
    masks = F.sort_array(F.collect_list(F.struct("word", "mask")))
    return _masks(bits).groupBy("file_number", "n_bits").agg(masks.getField("mask").alias("words"))


def may_contain_all(entries: DataFrame, keys: DataFrame, bits_per_key: int = 10, widest: int = WIDEST) -> DataFrame:
    """file_number, key, maybe for each file of entries(file_number, key) and each key of keys(key), as `may_contain`.

    Rows of whole filters meet rows of many keys, and only then become pairs, so that no pair is shuffled, sorted or
    kept. Filters of more than `widest` bits are probed word by word. A null is in no file, a null file has no key."""
    # no entry joins a null file: one clear word does for it
    sized = _sized(entries, bits_per_key).withColumn("n_bits", F.expr(f"if(file_number is null, {WORD}L, n_bits)"))
    whole, wide = sized.where(F.col("n_bits") <= widest), sized.where(F.col("n_bits") > widest)
    files, bits, most = sized.agg(F.count("*"), F.sum("n_bits"), F.max("n_bits")).first()
    keys = keys.select("key").distinct()
    # in order, so that a task that runs again numbers its keys alike
    numbered = keys.sortWithinPartitions("key").select(F.struct("key", _hash(F.col("key"), 0).alias("first"), _hash(F.col("key"), 1).alias("second")).alias("k"), F.floor(F.monotonically_increasing_id() / BLOCK).alias("block"))
    blocks = numbered.groupBy("block").agg(F.collect_list("k").alias("ks")).select("ks")
    filters = _whole(entries, whole).repartition(1 + max(files // FILES, (bits or 0) // (4 * WIDEST)))
    pairs = blocks.crossJoin(filters.hint("shuffle_replicate_nl")).select("file_number", "n_bits", "words", F.explode("ks").alias("k"))
    tests = [F.getbit(F.get("words", F.shiftright(at, SHIFT).cast("int")), at.bitwiseAND(WORD - 1)) == 1 for at in _probes(F.col("k.first"), F.col("k.second"), F.col("n_bits"))]
    out = pairs.select("file_number", "k.key", F.coalesce(reduce(Column.__and__, tests), F.lit(False)).alias("maybe"))
    if (most or 0) <= widest:
        return out
    return out.unionByName(may_contain(_masks(_bits(entries, wide)), keys.crossJoin(wide.select("file_number"))))
