"""Strongly connected components of any graph of states, by trimming, forward colours and backward confirmation.

Trimming drops edges of states without a predecessor or without a successor, which are components of their own. A state's
colour is the least key that reaches it; edges between colours join no component. Backward from the state that named a
colour, through that colour, lies its component. What is left of each colour goes through the same again. A round is one
join of the edges with what the last round changed, written to the shared folder; rounds follow the longest shortest path
and the number of components that lie behind one another in a colour, not the number of states.

Keys are of any type that can be ordered. Self-loops and repeated edges are allowed. An empty graph gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.ctl import Graph, laid
from tidegraph.scratch import materialize


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between states that have both predecessors and successors, again and again."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("post").alias("pre")).distinct(), edges.select(F.col("pre").alias("post")).distinct()
        edges = materialize(edges.join(into, "pre", "left_semi").join(out, "post", "left_semi").select("pre", "post"), "edges")
        if (m := edges.count()) == n:
            break
        n = m
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(key, colour) of the states of trimmed edges: the least key that reaches the state, itself included."""
    state = edges.select(F.col("pre").alias("key")).distinct().select("key", F.col("key").alias("colour"), F.lit(True).alias("moved"))
    state, edges = materialize(state, "colours"), laid(edges, "pre")
    while True:
        sent = edges.join(state.where("moved").select(F.col("key").alias("pre"), "colour"), "pre").groupBy(F.col("post").alias("key")).agg(F.min("colour").alias("m"))
        less = F.coalesce(F.col("m") < F.col("colour"), F.lit(False))
        state = materialize(state.drop("moved").join(sent, "key", "left").select("key", F.when(less, F.col("m")).otherwise(F.col("colour")).alias("colour"), less.alias("moved")), "colours")
        if state.where("moved").isEmpty():
            return state.select("key", "colour")


def _confirmed(inside: DataFrame) -> DataFrame:
    """inside(pre, post, colour), edges within colours, to (key, colour) of the states that reach the one of their colour's name."""
    inside = laid(inside, "post")
    last = materialize(inside.where("pre = colour").select(F.col("pre").alias("key"), "colour").distinct(), "confirmed")
    held = [last]
    while True:
        near = inside.join(last.select(F.col("key").alias("post")), "post", "left_semi").select(F.col("pre").alias("key"), "colour").distinct()
        last = materialize(near.join(reduce(DataFrame.unionByName, held).select("key"), "key", "left_anti"), "confirmed")
        if last.isEmpty():
            return reduce(DataFrame.unionByName, held)
        held.append(last)


def components(g: Graph) -> DataFrame:
    """(key, scc, size) of each state: the least key of its component, and how many states that has."""
    edges, found = materialize(g.edges.where("pre <> post"), "edges"), []
    while True:
        edges = _trimmed(edges)
        if edges.isEmpty():
            break
        colours = _colours(edges)
        pre, post = colours.select(F.col("key").alias("pre"), "colour"), colours.select(F.col("key").alias("post"), F.col("colour").alias("other"))
        inside = materialize(edges.join(pre, "pre").join(post, "post").where("colour = other").select("pre", "post", "colour"), "inside")
        found.append(_confirmed(inside))
        known = found[-1].select("key")
        edges = inside.join(known.withColumnRenamed("key", "pre"), "pre", "left_anti").join(known.withColumnRenamed("key", "post"), "post", "left_anti")
        edges = materialize(edges.select("pre", "post"), "edges")
    if not found:
        return g.nodes.select("key", F.col("key").alias("scc"), F.lit(1).cast("long").alias("size"))
    named = materialize(g.nodes.join(reduce(DataFrame.unionByName, found), "key", "left").select("key", F.coalesce("colour", "key").alias("scc")), "components")
    return named.join(named.groupBy("scc").agg(F.count("*").alias("size")), "scc").select("key", "scc", "size")


def non_trivial(g: Graph, members: DataFrame | None = None) -> DataFrame:
    """The components() that hold an infinite path: more than one state, or a state with an edge to itself."""
    members = components(g) if members is None else members
    loops = g.edges.where("pre = post").select(F.col("pre").alias("key"), F.lit(True).alias("loop"))
    return members.join(loops, "key", "left").where("size > 1 or loop").select("key", "scc", "size")
