"""Column functions of lists, with the index rules of the reference semantics, and of hashes of bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 64-bit ring hash: offset basis, and the prime 2**40 + 435.
OFFSET, PRIME_LOW = 1469598103934665603, 435
MASK = 0xFFFFFFFF


def lindex(items: Column, at: int) -> Column:
    """The element at a place, negative from the end; null out of range or without a list."""
    place = F.lit(at) if at >= 0 else F.size(items) + at
    return F.when(place >= 0, F.get(items, place))


def lrange(items: Column, start: int, stop: int) -> Column:
    """Elements from start to stop, both included and negative from the end. A start before the first
    counts as the first; a stop before it gives nothing."""
    n = F.size(items)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.when((b >= 0) & (a <= b) & (a < n), F.slice(items, a + 1, F.greatest(b - a + 1, F.lit(0)))).otherwise(F.slice(items, 1, 0))


def llen(items: Column) -> Column:
    return F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0))


def fnv_halves(text: Column) -> Column:
    """The ring's 64-bit hash as its 32-bit halves (hi, lo), which are kept apart, so no product
    overflows: times 2**40 + 435 is times 435 plus a shift of the low half by 8 bits into the high."""
    data = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substr(data, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET & MASK).cast("long").alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        low = acc["lo"].bitwiseXOR(byte(i))
        product = low * PRIME_LOW
        high = acc["hi"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), product.bitwiseAND(F.lit(MASK)).alias("lo"))

    places = F.when(F.length(data) > 0, F.sequence(F.lit(0), (F.length(data) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)


def fnv(text: Column) -> Column:
    """The ring's 64-bit hash as decimal(20, 0)."""
    done = fnv_halves(text)
    return (done["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + done["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")


def file_number(n: Column) -> Column:
    return F.lpad(n.cast("string"), 20, "0")
