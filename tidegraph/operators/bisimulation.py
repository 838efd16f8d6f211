"""Bisimulation classes of labelled graphs by partition refinement, and whether two graphs behave alike.

Each round gives a state the digest of its class and of the set of (step label, class of the successor): an exclusive or of
hashes of distinct pairs, so no list of successors is gathered and a hub is combined before it is shuffled. Classes are
known by 128 bits. Once a round makes no more classes than the one before, they are final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.scratch import materialize


def _digest(*parts: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def refined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(key, label), edges(pre, post, label) to (key, c1, c2): states of one (c1, c2) have one label and can match each
    other's steps for ever."""
    edges = materialize(edges.select("pre", "post", "label").distinct(), "edges")
    a, b = _digest(F.col("label"))
    now, count = materialize(nodes.select("key", a.alias("c1"), b.alias("c2")), "classes"), 0
    while (more := now.select("c1", "c2").distinct().count()) > count:
        count = more
        seen = edges.join(now.select(F.col("key").alias("post"), "c1", "c2"), "post").select("pre", "label", "c1", "c2").distinct()
        x, y = _digest(F.col("label"), F.col("c1"), F.col("c2"))
        steps = seen.groupBy(F.col("pre").alias("key")).agg(F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"))
        a, b = _digest(F.col("c1"), F.col("c2"), F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)), F.col("x").isNull())
        now = materialize(now.join(steps, "key", "left").select("key", a.alias("c1"), b.alias("c2")), "classes")
    return now


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, class, size): the least key of the states that behave alike, and how many there are."""
    now = refined(nodes, edges)
    named = now.groupBy("c1", "c2").agg(F.min("key").alias("class"), F.count("*").alias("size"))
    return now.join(named, ["c1", "c2"]).select("key", "class", "size")


def differing(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(side, key) of the states of two graphs (nodes, edges) that no state of the other graph matches; none if each can
    stand for the other. Both graphs are refined as one."""
    tag = lambda t, side, *names: t.select(*(F.struct(F.lit(side).alias("side"), F.col(n).alias("key")).alias(n) for n in names), "label")
    nodes = tag(first[0], 1, "key").unionByName(tag(second[0], 2, "key"))
    edges = tag(first[1], 1, "pre", "post").unionByName(tag(second[1], 2, "pre", "post"))
    now = refined(nodes, edges)
    sides = now.groupBy("c1", "c2").agg(F.min("key.side").alias("a"), F.max("key.side").alias("b")).where("a = b")
    return now.join(sides, ["c1", "c2"]).select("key.side", "key.key")
