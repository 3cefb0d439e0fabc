"""A Bloom filter of join keys as one array of longs, built and tested in the JVM.

``bloom_filter`` folds the keys of a table into ``2 ** log2_bits`` bits, a
scalar subquery of that fixed size whatever the table's; ``may_contain`` says
of a key that it is certainly not among them, or may be.  With more keys than
bits allow for, more keys may be: the filter then saves less and stays right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfolio.functions._util import as_col

#: 2^23 bits are one megabyte; with 3 hashes a million keys let 3 % of strangers through.
LOG2_BITS = 23
HASHES = 3


def _places(c: Column, log2_bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(c, F.lit(j)), F.lit(1 << log2_bits)) for j in range(hashes)]


def bloom_filter(keys: DataFrame, key: str, log2_bits: int = LOG2_BITS, hashes: int = HASHES) -> Column:
    """The filter of column ``key`` as a scalar ``array<bigint>``; NULL keys
    are in no filter."""
    place = keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), log2_bits, hashes))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = place.groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(bit).alias("w"))
    every = keys.sparkSession.range(1 << (log2_bits - 6)).join(words, "id", "left")
    pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))))
    return every.agg(F.transform(pairs, lambda x: x["w"]).alias("bits")).scalar()


def may_contain(bits: Column, key, log2_bits: int = LOG2_BITS, hashes: int = HASHES) -> Column:
    """False only for keys that the filter does not have (NULL is one)."""
    c = as_col(key)
    found = c.isNotNull()
    for p in _places(c, log2_bits, hashes):
        word = F.get(bits, F.shiftright(p, 6).cast("int"))
        found = found & (F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return found
