"""Connected components of a distributed list of links: alternating large-star and small-star steps.

No step brings links or labels to the driver; it sees only a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.files import delete
from tabulon.llm.common import written

_MAX_ROUNDS = 100


def _star(links: DataFrame, paths: list[str], rows: int) -> DataFrame:
    """Of each node u with neighbours v: hang u and every v on the least of them.  (node, least, v)"""
    # Both sides of the join come from files, so that adaptive execution can split a node with many links.
    least, path = written(links.groupBy("u").agg(F.min("v").alias("m")), "least", rows)
    paths.append(path)
    return links.join(least, "u")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link; the component is its least reachable node.

    Links without one of their ends, and those of a node with itself, are left out; order, direction
    and repeats don't matter.
    """
    spark = links.sparkSession
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now, path = written(ends.where("u > v").distinct(), "links")
    state = _state(now)
    for _ in range(_MAX_ROUNDS):
        paths = [path]
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, paths, 2 * state[0]).withColumn("m", F.least("m", "u")).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = written(large.distinct(), "large", 2 * state[0])
        paths.append(large_path)
        star = _star(large, paths, 2 * state[0])
        small = star.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.where("u > m").select("u", F.col("m").alias("v")))
        now, path = written(small.distinct(), "links", 2 * state[0])
        delete(spark, *paths)
        last, state = state, _state(now)
        if last == state:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.union(roots.withColumn("v", F.col("u"))).toDF("node", "component")
