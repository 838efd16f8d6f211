"""Temporal (CTL) operators as relational fixpoints over any table of states and any table of edges.

A graph is nodes(key) and edges(pre, post), keys of any scalar type; a state set is a table of keys. Fixpoints are
semi-naive: each round joins only what the last round added, and is written to the shared folder. Edges are laid out in
buckets of their later state, or of their earlier one for searches forward, once for all rounds: a round shuffles what it
found, not the edges. Dead ends satisfy AX and AF of anything they must (no successor refutes it) and never EG.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.scratch import in_buckets, materialize


def laid(edges: DataFrame, column: str) -> DataFrame:
    """edges written in as many buckets of a column as shuffles have partitions, a file each."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_buckets(edges.repartition(parts, column), column, parts, "edges")


class Graph:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes = nodes.select("key").distinct()
        self.edges = edges.select("pre", "post").distinct()
        self._laid: dict[str, DataFrame] = {}

    def laid_by(self, column: str) -> DataFrame:
        """The edges in buckets of a column, written once: joins on that column leave them where they lie."""
        if column not in self._laid:
            self._laid[column] = laid(self.edges, column)
        return self._laid[column]

    @classmethod
    def stored(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """A graph whose distinct nodes and edges are written once, for formulas of several operators."""
        g = cls(nodes, edges)
        g.nodes, g.edges = materialize(g.nodes, "nodes"), materialize(g.edges, "edges")
        return g

    @classmethod
    def of_edges(cls, edges: DataFrame) -> Graph:
        """A graph of the states that edges show: edges are worked out and written once, and the states read from them."""
        stored = materialize(edges.select("pre", "post").distinct(), "edges")
        g = cls(stored.select(F.explode(F.array("pre", "post")).alias("key")), stored)
        g.nodes, g.edges = materialize(g.nodes, "nodes"), stored
        return g

    # -- boolean connectives
    def without(self, a: DataFrame) -> DataFrame:
        return self.nodes.join(a, "key", "left_anti")

    @staticmethod
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, "key", "left_semi")

    @staticmethod
    def either(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).distinct()

    # -- one step
    def before(self, s: DataFrame) -> DataFrame:
        """States with a successor in s."""
        return self.laid_by("post").join(s.withColumnRenamed("key", "post"), "post", "left_semi").select(F.col("pre").alias("key")).distinct()

    EX = ex = before

    def ax(self, s: DataFrame) -> DataFrame:
        bad = self.laid_by("post").join(s.withColumnRenamed("key", "post"), "post", "left_anti").select(F.col("pre").alias("key")).distinct()
        return self.without(bad)

    # -- fixpoints
    def eu(self, p: DataFrame | None, q: DataFrame) -> DataFrame:
        """E[p U q]: backward from q through p; p None stands for all states."""
        q = self.both(q, self.nodes) if p is None else q
        held = [materialize(q.select("key").distinct(), "reached")]
        if p is not None:
            p = materialize(p, "through")
        while True:
            seen = reduce(DataFrame.unionByName, held)
            new = self.before(held[-1]).join(seen, "key", "left_anti")
            new = materialize(new if p is None else new.join(p, "key", "left_semi"), "reached")
            if new.isEmpty():
                return seen
            held.append(new)

    def ef(self, s: DataFrame) -> DataFrame:
        return self.eu(None, s)

    def ag(self, s: DataFrame) -> DataFrame:
        return self.without(self.ef(self.without(s)))

    def eg(self, s: DataFrame) -> DataFrame:
        """Greatest fixpoint: states of s lose their place when their last successor in s has lost it. What remains has
        an infinite path in s, that is, reaches a cycle. A round counts the edges into the states just lost, and writes
        those counts only; a state is lost once its counts reach its degree."""
        s = materialize(s.select("key").distinct(), "within")
        inside = self.edges.join(s.withColumnRenamed("key", "pre"), "pre", "left_semi").join(s.withColumnRenamed("key", "post"), "post", "left_semi")
        inside = laid(inside.select("pre", "post"), "post")
        degrees = materialize(inside.groupBy(F.col("pre").alias("key")).agg(F.count("*").alias("n")), "degrees")
        dead, cuts = s.join(degrees, "key", "left_anti"), []
        lost = dead
        while True:
            cut = inside.join(lost.select(F.col("key").alias("post")), "post", "left_semi").groupBy(F.col("pre").alias("key")).agg(F.count("*").alias("m"))
            cut = materialize(cut, "cut")
            if cut.isEmpty():
                break
            cuts.append(cut)
            lost = self._used_up(reduce(DataFrame.unionByName, cuts).join(cut.select("key"), "key", "left_semi"), degrees)
        if cuts:
            dead = dead.unionByName(self._used_up(reduce(DataFrame.unionByName, cuts), degrees))
        return s.join(materialize(dead, "lost"), "key", "left_anti")

    @staticmethod
    def _used_up(cuts: DataFrame, degrees: DataFrame) -> DataFrame:
        return cuts.groupBy("key").agg(F.sum("m").alias("m")).join(degrees, "key").where("m = n").select("key")

    def af(self, s: DataFrame) -> DataFrame:
        return self.without(self.eg(self.without(s)))

    def au(self, p: DataFrame, q: DataFrame) -> DataFrame:
        no_q = materialize(self.without(q), "not")
        no_p = self.both(self.without(p), no_q)
        return self.without(self.either(self.eu(no_q, no_p), self.eg(no_q)))

    def within(self, goal: DataFrame, steps: int) -> DataFrame:
        """States all of whose paths meet the goal in at most so many steps; a dead end before it fails."""
        goal = materialize(self.both(goal, self.nodes), "goal")
        alive = self.edges.select(F.col("pre").alias("key")).distinct()
        s = goal
        for _ in range(steps):
            s = materialize(self.either(goal, self.both(self.ax(s), alive)), "within")
        return s

    # -- fairness
    def eg_fair(self, s: DataFrame, fair: list[DataFrame], strict: bool = False) -> DataFrame:
        """EG with every set of fair met over and over. By default the shrinking that counts a state as reaching itself,
        which keeps some states whose only fair meeting is a dead end; strict: the exact Emerson-Lei fixpoint."""
        if not fair:
            return self.eg(s)
        q = materialize(s.select("key").distinct(), "fair")
        n = q.count()
        while n:
            new = q
            for f in fair:
                goal = self.both(q, f)
                if strict:
                    reach = self.both(self.before(self.eu(q, goal)), q)
                else:
                    reach = self.eu(q, goal)
                new = self.both(new, reach)
            q = materialize(new, "fair")
            if (m := q.count()) == n:
                break
            n = m
        return q if strict else self.eg(q)

    # -- formulas
    def label(self, formula: dict, atom: Callable[[dict], DataFrame], fair: list[DataFrame] | None = None, strict: bool = False) -> DataFrame:
        """The states that satisfy a formula. atom gives those of a predicate. Fairness reaches EG, AF and AU only, and
        not below AG, EF, AX and EX, unless strict."""
        kind = formula["kind"]
        sub = lambda f, fair=fair: self.label(f, atom, fair, strict)
        keep = fair if strict else None
        if kind == "atom":
            return atom(formula["predicate"])
        if kind == "fnot":
            return self.without(sub(formula["arg"]))
        if kind == "fand":
            return reduce(self.both, map(sub, formula["args"]), self.nodes)
        if kind == "for":
            return reduce(self.either, map(sub, formula["args"]), self.nodes.where("false"))
        if kind in ("EU", "AU"):
            p, q = sub(formula["left"]), sub(formula["right"])
            if kind == "EU":
                return self.eu(p, q)
            if not fair:
                return self.au(p, q)
            no_q = materialize(self.without(q), "not")
            return self.without(self.either(self.eu(no_q, self.both(self.without(p), no_q)), self.eg_fair(no_q, fair, strict)))
        if kind == "EG":
            return self.eg_fair(sub(formula["arg"]), fair or [], strict)
        if kind == "AF":
            return self.without(self.eg_fair(self.without(sub(formula["arg"])), fair or [], strict))
        s = sub(formula["arg"], keep)
        return {"EX": self.ex, "AX": self.ax, "EF": self.ef, "AG": self.ag}[kind](s)

    # -- paths
    def distances(self, start: DataFrame, goal: DataFrame | None = None) -> DataFrame:
        """(key, distance) forward from start, until a goal is met or nothing is new."""
        held = [materialize(start.select("key", F.lit(0).alias("distance")), "reached")]
        while True:
            last, seen = held[-1], reduce(DataFrame.unionByName, held)
            if goal is not None and not self.both(last, goal).isEmpty():
                return seen
            new = self.laid_by("pre").join(last.withColumnRenamed("key", "pre"), "pre").groupBy(F.col("post").alias("key")).agg((F.min("distance") + 1).alias("distance"))
            new = materialize(new.join(seen, "key", "left_anti"), "reached")
            if new.isEmpty():
                return seen
            held.append(new)


def atom(predicate: dict) -> dict:
    return {"kind": "atom", "predicate": predicate}


def _unary(kind: str):
    return lambda f: {"kind": kind, "arg": f}


fnot, EX, AX, EF, AF, EG, AG = map(_unary, ("fnot", "EX", "AX", "EF", "AF", "EG", "AG"))


def fand(*fs: dict) -> dict:
    return {"kind": "fand", "args": list(fs)}


def for_(*fs: dict) -> dict:
    return {"kind": "for", "args": list(fs)}


def implies(a: dict, b: dict) -> dict:
    return for_(fnot(a), b)


def EU(p: dict, q: dict) -> dict:
    return {"kind": "EU", "left": p, "right": q}


def AU(p: dict, q: dict) -> dict:
    return {"kind": "AU", "left": p, "right": q}


def fairness(condition: dict, name: str | None = None) -> dict:
    return {"condition": condition, **({"name": name} if name else {})}
