"""Connected components of a graph given as pairs, by alternating large and small stars.

Each round joins every node to the least node around it; the number of pairs never grows. Rounds go on until
one changes nothing, as many as the graph needs (about the square of the logarithm of its nodes at most). Rounds are
written to the shared folder, and only their count and checksum come to the driver. A hub with a large
part of all pairs is a hot key of a join between two shuffled sides, which adaptive execution splits;
its least neighbour is found by partial minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.llm.tables import written


def with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select(F.col("u").alias("of"), F.least("u", "least").alias("least"))
    return pairs.join(least, F.col("u") == F.col("of")).drop("of")


def components(pairs: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id that stands in a pair of two ids."""
    pairs = pairs.toDF("u", "v").where("u != v")
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    before = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = with_least(large.where("u != v").distinct())
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v")))
        pairs = written(small.where("u != v").distinct(), "pairs")
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
