"""Bounded response over a graph of states: after a trigger, every path meets the goal within so many steps.

One backward labelling serves all triggers. A state fails with n steps left if it misses the goal and n is 0, or it has no
successor, or one of its successors fails with n - 1 left; the least of those is kept as a pointer. Following the pointers
forward once from all failing triggers gives a missed path for each. So the work is one join of the edges a step, whatever
the number of triggers, and no path travels before it is known to be reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.ctl import Graph, laid
from tidegraph.scratch import materialize


def failing(g: Graph, goal: DataFrame, steps: int, order: str = "post") -> DataFrame:
    """(left, key, next): states that can miss goal(key) with so many steps left, up to steps; next is the successor with
    the least value of the edge column order that fails, null at the bound and at dead ends. States that fail with more
    steps fail with fewer, so once no state is lost between two steps the last one stands for all further ones."""
    misses = materialize(g.without(goal), "misses")
    stuck = misses.join(g.edges.select(F.col("pre").alias("key")), "key", "left_anti")
    edges = g.laid_by("post") if order in ("pre", "post") else laid(g.edges, "post")
    nothing = F.lit(None).cast(g.edges.schema["post"].dataType)
    last = misses.select("key", nothing.alias("next"))
    out, n = [last.withColumn("left", F.lit(0))], misses.count()
    for left in range(1, steps + 1):
        moves = edges.join(last.select(F.col("key").alias("post")), "post", "left_semi").groupBy(F.col("pre").alias("key")).agg(F.min_by("post", order).alias("next"))
        last = materialize(moves.join(misses, "key", "left_semi").unionByName(stuck.select("key", nothing.alias("next"))), "failing")
        out.append(last.withColumn("left", F.lit(left)))
        if (m := last.count()) == n:
            out += [last.withColumn("left", F.lit(more)) for more in range(left + 1, steps + 1)]
            break
        n = m
    return reduce(DataFrame.unionByName, out).select("left", "key", "next")


def missed(g: Graph, fired: DataFrame, goal: DataFrame, steps: int, order: str = "post") -> DataFrame:
    """fired(pre, post), trigger edges, to (pre, post, step, at, next) of those after which a path misses the goal: step 0
    is the trigger itself, and a path ends where next is null (a dead end, or the bound)."""
    labels = materialize(failing(g, goal, steps, order), "labels")
    at = fired.select("pre", "post").distinct().select("pre", "post", F.col("post").alias("at"))
    out = []
    for step in range(steps + 1):
        here = labels.where(F.col("left") == steps - step).select(F.col("key").alias("at"), "next")
        found = materialize(at.join(here, "at").select("pre", "post", F.lit(step + 1).alias("step"), "at", "next"), "path")
        out.append(found)
        at = found.where("next is not null").select("pre", "post", F.col("next").alias("at"))
    first = out[0].select("pre", "post", F.lit(0).alias("step"), F.col("pre").alias("at"), F.col("post").alias("next"))
    return reduce(DataFrame.unionByName, out, first)


def met(g: Graph, fired: DataFrame, goal: DataFrame, steps: int) -> DataFrame:
    """fired(pre, post) with met: whether every path from post meets the goal within so many steps."""
    bad = failing(g, goal, steps).where(F.col("left") == steps).select(F.col("key").alias("post"), F.lit(False).alias("ok"))
    return fired.select("pre", "post").distinct().join(bad, "post", "left").select("pre", "post", F.col("ok").isNull().alias("met"))
