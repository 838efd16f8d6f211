"""Connected components of a table of links by alternating large-star and small-star rounds, roots of forests by pointer
doubling, and joins on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.scratch import materialize

#: Rows of a key from which it may be hot.
HOT = 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> list:
    """The keys of counts(key, n) that have more than a share of total rows: at most two for each shuffle partition."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(HOT, total // (2 * parts))
    return [] if total <= limit else [r[0] for r in counts.where((F.col("n") > limit) & F.col(key).isNotNull()).select(key).collect()]


def join_spread(big: DataFrame, small: DataFrame, key: str, spread: str, hot: list, how: str = "inner") -> DataFrame:
    """big.join(small, key), small with one row for each key. The rows of hot keys and of none are dealt to all partitions
    by the column spread of big, and small's rows of those keys go to each."""
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    big = big.withColumn("_salt", F.when(F.col(key).isNull() | is_hot, F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return big.join(small.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges(a, b) with m, the least b of each a. A node with very many links is no large group: minima are combined before
    they are shuffled, and come back to its links wherever these are."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if total <= HOT:
        return edges.join(least.drop("n"), "a")
    least = materialize(least, "least")
    return join_spread(edges, least.drop("n"), "a", "b", hot_keys(least, "a", total))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of any type that can be ordered, any order and repeats, to (node, component): each node that has a link,
    and the smallest node that it reaches. Each round is written to the shared folder; the rounds grow with the logarithm
    of the longest path."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    while mark.n:
        edges = edges.coalesce(1) if mark.n <= HOT else edges  # so few links need no shuffle
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * mark.n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large") if mark.n > HOT else large
        small = with_least(large, mark.n).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == now:
            break
        mark = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def roots(links: DataFrame) -> DataFrame:
    """components() of links(a, b) where each a has one link, to a smaller b, by pointer doubling: in each round a node takes
    over its target's target. The rounds grow with the logarithm of the longest way; each is written to the shared folder."""
    at, n = links.select("a", "b"), links.count()
    while n:
        hot = hot_keys(at.groupBy("b").agg(F.count("*").alias("n")), "b", n)
        ups = at.select(F.col("a").alias("b"), F.col("b").alias("up"))
        at = join_spread(at, ups, "b", "a", hot, "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved"))
        at = materialize(at, "roots")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    stars = at.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
