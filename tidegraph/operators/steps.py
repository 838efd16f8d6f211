"""Step predicates over edges, and bounded response."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.exprs import Scope, Val, literal, same, true
from tidegraph.model import QUEUE_ROLE, Model, effects_in
from tidegraph.operators.ctl import Graph as Observed
from tidegraph.operators.explore import Explorer, Graph
from tidegraph.operators.response import missed
from tidegraph.scratch import materialize


def queue_of(model: Model, t: dict) -> str | None:
    """The queue that a transition's effect uses, if it is one."""
    names = {model.queue(x.get("queue")) for x in effects_in(t["effect"]) if x["kind"] in ("enqueue", "dequeue")}
    if len(names) == 1:
        return names.pop()
    queues = [v["id"] for v in model.vars if (v.get("role") or {}).get("kind") == QUEUE_ROLE or v["id"] == "sys:pending"]
    return queues[0] if len(queues) == 1 else None


class Steps:
    """Compiles step predicates over edges(tid, pre_s, post_s)."""

    def __init__(self, model: Model):
        self.model, self.rules = model, list(enumerate(model.sorted_transitions))

    def _of(self, wanted) -> Column:
        ids = [i for i, t in self.rules if wanted(t)]
        return F.col("tid").isin(*ids) if ids else F.lit(False)

    def _first_missing(self, a: Column, b: Column, name: str) -> Val:
        """The first operation of queue `name` in state a that state b does not have."""
        x, y = Scope(self.model, a).var(name), Scope(self.model, b).var(name)
        gone = F.filter(x.col, lambda op: ~F.exists(y.col, lambda o: o.eqNullSafe(op)))
        return Val(F.get(gone, F.lit(0)), x.shape[1])

    def _by_queue(self, make) -> list[tuple[Column, Any]]:
        """make(queue) for every queue in use, with the condition that the edge's transition uses it."""
        names = {queue_of(self.model, t) for _, t in self.rules} - {None}
        return [(self._of(lambda t, n=n: queue_of(self.model, t) == n), make(n)) for n in sorted(names)]

    def op(self) -> Val | None:
        """The operation that a step enqueued, or else took: null where neither."""
        found = self._by_queue(lambda n: (self._first_missing(F.col("post_s"), F.col("pre_s"), n), self._first_missing(F.col("pre_s"), F.col("post_s"), n)))
        if not found:
            return None
        shape = found[0][1][0].shape
        return Val(reduce(lambda rest, x: F.when(x[0], F.coalesce(x[1][0].col, x[1][1].col)).otherwise(rest), found, F.lit(None).cast(_ddl(shape))), shape)

    def flat(self, p: dict) -> Column:
        m, out = self.model, []
        pre, post = Scope(m, F.col("pre_s")), Scope(m, F.col("post_s"))
        if "transitionId" in p:
            out.append(self._of(lambda t: t["id"] == p["transitionId"]))
        if "transitionClass" in p:
            out.append(self._of(lambda t: t["cls"] == p["transitionClass"]))
        if "labelKind" in p:
            out.append(self._of(lambda t: t["label"].get("kind") == p["labelKind"]))
        if "enqueued" in p:
            new = self._by_queue(lambda n: self._first_missing(F.col("post_s"), F.col("pre_s"), n))
            out.append(reduce(lambda a, b: a | b, (w & F.coalesce(v.col.getField("opId") == p["enqueued"], F.lit(False)) for w, v in new), F.lit(False)))
        if "resolved" in p:
            op, *outcome = [x for x in p["resolved"] if x is not None]
            out.append(self._of(lambda t: t["label"].get("kind") == "resolve" and t["label"].get("op") == op and (not outcome or t["label"].get("outcome") == outcome[0])))
        if "changed" in p:
            out.append(~same(pre.var(p["changed"]), post.var(p["changed"])))
        if "changedTo" in p:
            v = p["changedTo"]["var"]
            out.append(~same(pre.var(v), post.var(v)) & same(post.var(v), literal(p["changedTo"]["value"])))
        if {"opId", "continuation", "opArgs"} & set(p):
            op = self.op()
            if op is None:
                return F.lit(False)
            for key, field in (("opId", "opId"), ("continuation", "continuation")):
                if key in p:
                    out.append(F.coalesce(op.col.getField(field) == p[key], F.lit(False)))
            for k, v in (p.get("opArgs") or {}).items():
                out.append(op.col.isNotNull() & same(pre.path(op, ["args", k]), literal(v)))
        return reduce(lambda a, b: a & b, out, F.lit(True))

    def matches(self, p: dict) -> Column:
        """A flat predicate, or {pre, step, post, negate}."""
        if "step" not in p:
            return self.flat(p)
        op = self.op()
        args = None if op is None or "args" not in dict(op.shape[1]) else Val(op.col.getField("args"), dict(op.shape[1])["args"])
        if args is not None and args.shape[0] != "rec":
            args = None
        out = self.flat(p["step"])
        for key, at in (("pre", "pre_s"), ("post", "post_s")):
            if p.get(key) is not None:
                out = out & true(Scope(self.model, F.col(at), F.col("pre_s"), args).eval(p[key]))
        out = F.coalesce(out, F.lit(False))
        return ~out if p.get("negate") else out

    def mounted(self, p: dict) -> Column:
        """All mount-local variables that a property reads are there before and after."""
        guards = [self.model.mount_guard(self.model.var(r)) for r in p.get("reads", ()) if r in self.model.index]
        if p.get("includeUnmounted"):
            guards = []
        return reduce(lambda a, g: a & Scope(self.model, F.col("pre_s")).mounted(g) & Scope(self.model, F.col("post_s")).mounted(g), (g for g in guards if g is not None), F.lit(True))


def _ddl(shape) -> str:
    from tidegraph.functions.domains import ddl

    return ddl(shape)


def step_violations(graph: Graph, prop: dict) -> DataFrame:
    """Edges that break an alwaysStep property; edges into states seen before count too."""
    s = Steps(graph.model)
    return graph.edges.where(s.mounted(prop) & ~s.matches(prop["predicate"]))


def triggers(graph: Graph, prop: dict) -> DataFrame:
    return graph.edges.where(Steps(graph.model).flat(prop["trigger"]))


def leads_to(explorer: Explorer, starts: DataFrame, goal: dict, steps: int, user_events: bool = False) -> DataFrame:
    """The starts(key, s) from which some path of scheduler steps misses the goal within the bound, with a missing path.

    Rows (key, path): path is an array of (tid, post_s), at each state the first failing step by transition. Forward, each
    state that starts reach within the bound without meeting the goal is expanded once; backward, one labelling serves all
    starts (see response); forward again, pointers are followed from those that fail."""
    m = explorer.model
    allowed = [i for i, t in enumerate(m.sorted_transitions) if t["cls"] in ("env", "library", "internal") or (user_events and t["cls"] in ("user", "nav"))]
    waits = ~true(Scope(m, F.col("s")).eval(goal))
    at = materialize(starts.select("key", "s").dropDuplicates(["key"]).where(waits), "waiting")
    first, seen, taken = at, [at], []
    for _ in range(steps if allowed else 0):
        out = explorer.expand(at).where(F.col("tid").isin(*allowed)).select("pre", "tid", "post", "post_s")
        taken.append(materialize(out, "steps"))
        new = taken[-1].select(F.col("post").alias("key"), F.col("post_s").alias("s")).dropDuplicates(["key"]).where(waits)
        at = materialize(new.join(reduce(DataFrame.unionByName, seen).select("key"), "key", "left_anti"), "waiting")
        if at.isEmpty():
            break
        seen.append(at)
    nodes = reduce(DataFrame.unionByName, seen).select("key")
    key = starts.schema["key"].dataType
    if taken:
        all_ = reduce(DataFrame.unionByName, taken)
        edges = materialize(all_.groupBy("pre", "post").agg(F.min("tid").alias("tid"), F.min_by("post_s", "tid").alias("post_s")), "edges")
    else:
        edges = nodes.select(F.col("key").alias("pre"), F.col("key").alias("post"), F.lit(0).alias("tid"), F.lit(None).cast(starts.schema["s"].dataType).alias("post_s")).where("false")
    # A step into a state that meets the goal keeps its own state from being a dead end.
    met = edges.select(F.col("post").alias("key")).join(nodes, "key", "left_anti")
    g = Observed(nodes.unionByName(met), edges)
    g.edges = edges.withColumn("order", F.struct("tid", "post"))
    found = missed(g, first.select(F.col("key").alias("pre"), F.col("key").alias("post")), met, steps, "order").where("step > 0")
    way = found.select(F.col("pre").alias("key"), "step", F.col("at").alias("pre"), F.col("next").cast(key).alias("post")).join(edges, ["pre", "post"], "left")
    path = F.array_sort(F.collect_list(F.when(F.col("tid").isNotNull(), F.struct("step", "tid", "post_s"))))
    return way.groupBy("key").agg(F.transform(path, lambda x: F.struct(x.tid.alias("tid"), x.post_s.alias("post_s"))).alias("path"))


# Builders.
def step_enqueued(op: str) -> dict:
    return {"enqueued": op}


def step_resolved(op: str, outcome: str | None = None) -> dict:
    return {"resolved": [op] if outcome is None else [op, outcome]}


def step_transition(id_: str) -> dict:
    return {"transitionId": id_}


def step_any() -> dict:
    return {}


def step_changed(var: str) -> dict:
    return {"changed": var}


def step_changed_to(var: str, value: Any) -> dict:
    return {"changedTo": {"var": var, "value": value}}
