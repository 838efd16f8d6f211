"""Traces: parent chains, their steps, comparison of expected and observed steps, random walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.functions.exprs import Scope, same
from tidegraph.model import Model
from tidegraph.operators.ctl import laid
from tidegraph.operators.explore import Explorer, Graph
from tidegraph.scratch import materialize


def root_paths(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """parents(key, parent, ...), parent null at a root, to (target, back, key, parent, ...) of targets(key): each state on
    the way to the root, back steps before the target, with its row of parents.

    By pointer doubling: round k knows each state's ancestor 2**k steps up, and doubles the stretch of way that each
    target knows. So rounds follow the logarithm of the depth, for all targets at once, and every step of a way is found
    by one join. Parents that form a cycle are refused."""
    most = parents.count()
    up = materialize(parents.where("parent is not null").select("key", F.col("parent").alias("up")), "ancestors")
    ways = targets.select("key").distinct().join(parents.select("key"), "key", "left_semi")
    ways, far = materialize(ways.select(F.col("key").alias("target"), F.lit(0).cast("long").alias("back"), "key"), "ways"), 1
    held = [ways]
    while not up.isEmpty():
        if far > most:
            raise ValueError("parents form a cycle")
        known = reduce(DataFrame.unionByName, held)
        more = known.join(up, "key").select("target", (F.col("back") + far).alias("back"), F.col("up").alias("key"))
        more, far = materialize(more, "ways"), 2 * far
        if more.isEmpty():
            break
        held.append(more)
        up = materialize(up.join(up.select(F.col("key").alias("up"), F.col("up").alias("upper")), "up").select("key", F.col("upper").alias("up")), "ancestors")
    return reduce(DataFrame.unionByName, held).join(parents, "key").select("target", "back", *parents.columns)


def forest(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(key, depth, parent) of all states that start(key) reaches over edges(pre, post): fewest steps, and of the states one
    step nearer the least. One round a layer, each written to the shared folder."""
    kind, edges = edges.schema["pre"].dataType, laid(edges.select("pre", "post"), "pre")
    held = [materialize(start.select("key").distinct().select("key", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")), "layer")]
    while True:
        last, seen = held[-1], reduce(DataFrame.unionByName, held)
        new = edges.join(last.select(F.col("key").alias("pre")), "pre").groupBy(F.col("post").alias("key")).agg(F.min("pre").alias("parent"))
        new = materialize(new.join(seen.select("key"), "key", "left_anti").select("key", F.lit(len(held)).alias("depth"), "parent"), "layer")
        if new.isEmpty():
            return seen
        held.append(new)


def trace_to(graph: Graph, targets: DataFrame) -> DataFrame:
    """Steps (target, step, tid, pre, post) of the parent chains of targets(key), for all of them at once."""
    way = root_paths(graph.states.select("key", "parent", "depth", "tid"), targets)
    return way.where("parent is not null").select("target", F.col("depth").alias("step"), "tid", F.col("parent").alias("pre"), F.col("key").alias("post"))


def named(graph: Graph, steps: DataFrame) -> DataFrame:
    """Adds transition_id to rows with a tid."""
    ids = F.array(*(F.lit(t["id"]) for t in graph.model.sorted_transitions))
    return steps.withColumn("transition_id", F.get(ids, F.col("tid")))


def diff(model: Model, pre: Column, post: Column) -> Column:
    """Array of (var, before, after) as JSON text for the variables that differ."""
    a, b, each = Scope(model, pre), Scope(model, post), []
    for v in model.vars:
        x, y = a.var(v["id"]), b.var(v["id"])
        text = lambda c: F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$.v")
        each.append(F.when(~same(x, y), F.struct(F.lit(v["id"]).alias("var"), text(x.col).alias("before"), text(y.col).alias("after"))))
    return F.filter(F.array(*each), lambda d: d.isNotNull())


def trace_ids(graph: Graph, key) -> list[str]:
    """Transition ids from the start to one state, for reports: as many as the state is deep."""
    one = graph.states.where(F.col("key") == F.lit(bytes(key)))
    return [r.transition_id for r in named(graph, trace_to(graph, one)).orderBy("step").select("transition_id").collect()]


def replayable(model: Model, ids: list[str]) -> bool:
    """Clicks, submits and inputs need a locator to be replayed."""
    labels = (model.by_id[i]["label"] for i in ids)
    return all(x.get("kind") not in ("click", "submit", "input") or x.get("locator") for x in labels)


def compare_steps(expected: DataFrame, observed: DataFrame, by: tuple[str, ...] = ("trace",)) -> DataFrame:
    """expected and observed(by, step, pre, post) to a verdict for each trace: reproduced, not-reproduced (with the first
    differing step), or inconclusive where observations end early."""
    o = observed.select(*by, "step", F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.lit(True).alias("seen"))
    j = expected.join(o, [*by, "step"], "left")
    wrong = F.col("seen").isNotNull() & ~(F.col("pre").eqNullSafe(F.col("o_pre")) & F.col("post").eqNullSafe(F.col("o_post")))
    r = j.groupBy(*by).agg(F.min(F.when(wrong, F.col("step"))).alias("first_wrong"), F.min(F.when(F.col("seen").isNull(), F.col("step"))).alias("first_missing"))
    status = F.when(F.col("first_wrong").isNotNull() & (F.col("first_missing").isNull() | (F.col("first_wrong") < F.col("first_missing"))), "not-reproduced").when(F.col("first_missing").isNotNull(), "inconclusive").otherwise("reproduced")
    return r.select(*by, status.alias("status"), F.when(status == "not-reproduced", F.col("first_wrong")).alias("at_step"))


RANK = {"exact": 0, "over-approx": 1, "manual": 2}  # fixed values: confidence of a transition, best first


def random_walks(explorer: Explorer, walks: int, steps: int, seed: int = 1) -> DataFrame:
    """(walk, step, tid, pre, post): walks in lockstep, one layer a step. Each walk has a linear congruential state that
    chooses among its successors sorted by (confidence, id, key)."""
    rank = F.array(*(F.lit(RANK.get(t.get("confidence", "exact"), 3)) for t in explorer.model.sorted_transitions))
    lcg = lambda c: F.pmod(c * 1664525 + 1013904223, F.lit(1 << 32))
    start = explorer.initial().orderBy("key").limit(1).select("key", "s")
    at = explorer.spark.range(walks).select(F.col("id").alias("walk"), lcg(F.col("id") + seed).alias("random")).crossJoin(F.broadcast(start))  # one row
    out = []
    for n in range(1, steps + 1):
        at = materialize(at, "walks")
        near = explorer.expand(at.select("key", "s").dropDuplicates(["key"])).dropDuplicates(["pre", "tid", "post"])
        w = Window.partitionBy("pre").orderBy(F.get(rank, F.col("tid")), "tid", "post")
        near = materialize(near.select("pre", "tid", "post", "post_s", (F.row_number().over(w) - 1).alias("place"), F.count("*").over(Window.partitionBy("pre")).alias("all")), "near")
        sizes = near.select(F.col("pre").alias("key"), "all").distinct()
        chosen = at.join(sizes, "key").withColumn("place", F.pmod("random", F.col("all")).cast("int"))
        moved = chosen.join(near.drop("all").withColumnRenamed("pre", "key"), ["key", "place"])
        moved = materialize(moved.select("walk", "tid", F.col("key").alias("pre"), "post", "post_s", "random"), "moved")
        out.append(moved.select("walk", F.lit(n).alias("step"), "tid", "pre", "post"))
        at = moved.select("walk", lcg(F.col("random")).alias("random"), F.col("post").alias("key"), F.col("post_s").alias("s"))
        if at.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def walk_metrics(results: DataFrame) -> DataFrame:
    """results(walk, tid, passed) to attempts, passes and pass rate for each transition."""
    return results.groupBy("tid").agg(F.count("*").alias("attempts"), F.sum(F.col("passed").cast("long")).alias("passes"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))
