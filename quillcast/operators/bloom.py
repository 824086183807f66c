"""A Bloom filter of keys, built as an aggregate and applied where a large table is scanned.

The filter is one array of 64-bit words, found by a scalar subquery in the same plan: no job
runs while the plan is built. All bits of a key lie in one word, so a look-up reads one
place. It lets some rows through that have none of the keys, so an exact join
follows; it holds back none that have one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23  # 1 MB; of a million keys some 5 in 100 others pass
PROBES = 3


def _slot(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(0)), 64 - (bits - 6)).cast("int")


def _mask(key: str) -> Column:
    spread = F.xxhash64(F.col(key), F.lit(1))
    places = (F.shiftrightunsigned(spread, 6 * i).bitwiseAND(63).cast("int") for i in range(PROBES))
    one = F.lit(1).cast("bigint")
    return reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", one, p) for p in places))


def bloom_filter(keys: DataFrame, key: str, bits: int = BITS) -> Column:
    """The filter of all ``keys``, however often they occur; its size is fixed by ``bits``."""
    if not 7 <= bits <= 27:
        raise ValueError("a filter has 2**7 to 2**27 bits")
    words = keys.groupBy(_slot(key, bits).alias("slot")).agg(F.bit_or(_mask(key)).alias("word"))
    every = keys.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("slot"))
    filled = every.join(words, "slot", "left").select("slot", F.coalesce("word", F.lit(0)).alias("word"))
    in_order = F.array_sort(F.collect_list(F.struct("slot", "word")))  # of fixed length
    return filled.agg(F.transform(in_order, lambda x: x["word"]).alias("words")).scalar()


def may_hold(words: Column, key: str, bits: int = BITS) -> Column:
    """False for keys that the filter was surely not built of."""
    missing = F.bitwise_not(F.get(words, _slot(key, bits))).bitwiseAND(_mask(key))
    return missing == 0
