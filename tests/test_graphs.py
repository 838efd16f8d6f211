"""Components, bounded response and ways to roots on graphs, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph.model import parse_model
from tidegraph.operators import ctl, response, scc, traces
from tidegraph.operators.steps import Steps, leads_to, step_changed_to
from tidegraph.sources import observed
from tidegraph.sources.rows import row_model


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def graph(spark, edges, extra=()):
    nodes = sorted({x for e in edges for x in e} | set(extra))
    return ctl.Graph(spark.createDataFrame([(x,) for x in nodes], "key string"), spark.createDataFrame(edges + edges[:3], "pre string, post string"))


def reach(edges, a):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        for u, v in edges:
            if u == x and v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


@pytest.mark.parametrize(("n", "m", "seed"), [(20, 18, 1), (20, 30, 2), (30, 60, 3), (1, 1, 4)])
def test_components(spark, n, m, seed):
    edges = random_edges(n, m, seed)
    g = graph(spark, edges, ["lone"])
    nodes = {x for e in edges for x in e} | {"lone"}
    to = {x: reach(edges, x) for x in nodes}
    of = {x: min({x} | {y for y in to[x] if x in to[y]}) for x in nodes}
    want = sorted((x, of[x], sum(of[y] == of[x] for y in nodes)) for x in nodes)
    got = scc.components(g)
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, scc.non_trivial(g, got).collect())) == [r for r in want if r[0] in to[r[0]]]


def test_components_behind_one_another(spark):
    """A chain of rings, so that one colour holds many components, and a graph without edges."""
    edges = [(f"r{i}{a}", f"r{i}{b}") for i in range(4) for a, b in ("ab", "bc", "ca")] + [(f"r{i}c", f"r{i + 1}a") for i in range(3)]
    got = scc.components(graph(spark, edges)).collect()
    assert sorted(map(tuple, got)) == sorted((f"r{i}{x}", f"r{i}a", 3) for i in range(4) for x in "abc")
    alone = ctl.Graph(spark.createDataFrame([("x",)], "key string"), spark.createDataFrame([], "pre string, post string"))
    assert [tuple(r) for r in scc.components(alone).collect()] == [("x", "x", 1)] and scc.non_trivial(alone).collect() == []


def failing_path(edges, goal, at, left):
    if at in goal:
        return None
    after = sorted(v for u, v in edges if u == at)
    if left == 0 or not after:
        return [at]
    for v in after:
        if (way := failing_path(edges, goal, v, left - 1)) is not None:
            return [at, *way]
    return None


@pytest.mark.parametrize(("steps", "seed"), [(0, 1), (1, 2), (3, 3), (6, 4), (40, 5)])
def test_bounded_response(spark, steps, seed):
    edges = random_edges(25, 35, seed)
    g, rng = graph(spark, edges), random.Random(seed)
    goal = set(rng.sample(sorted({x for e in edges for x in e}), 6))
    fired = [e for e in edges if rng.random() < 0.6]
    want = {e: failing_path(edges, goal, e[1], steps) for e in fired}
    f, q = spark.createDataFrame(fired, "pre string, post string"), spark.createDataFrame([(x,) for x in goal], "key string")
    rows = response.missed(g, f, q, steps).orderBy("step").collect()
    got = {}
    for r in rows:
        got.setdefault((r.pre, r.post), []).append(r.at)
    assert got == {e: [e[0], *w] for e, w in want.items() if w is not None}
    assert {(r.pre, r.post): r.met for r in response.met(g, f, q, steps).collect()} == {e: w is None for e, w in want.items()}


def test_leads_to_follows_the_first_failing_step(spark):
    """Two environment steps from n: up adds one, jump adds two and is blocked above 2; the goal is n = 3."""
    lit, n = (lambda v: {"kind": "lit", "value": v}), {"kind": "read", "var": "n"}
    op = lambda k, *a: {"kind": k, "args": list(a)}
    rule = lambda i, g, e: {"id": i, "cls": "env", "label": {"kind": "x"}, "source": [], "guard": g, "effect": {"kind": "assign", "var": "n", "expr": e}, "reads": [], "writes": [], "confidence": "exact"}
    m = parse_model({"schemaVersion": 1, "id": "c", "bounds": {"maxDepth": 9}, "vars": [{"id": "n", "domain": {"kind": "boundedInt", "min": 0, "max": 5, "overflow": "forbid"}, "origin": "system", "scope": {"kind": "global"}, "initial": [0, 1, 2, 3]}], "transitions": [rule("up", lit(True), op("add", n, lit(1))), rule("jump", op("lte", n, lit(2)), op("add", n, lit(2)))]})
    from tidegraph.operators.explore import Explorer

    e = Explorer(spark, m)
    starts = e.initial().select("key", "s")
    n_of = {bytes(r.key): r.s[0] for r in starts.collect()}
    tid = {i: t["id"] for i, t in enumerate(m.sorted_transitions)}
    for steps, want in ((0, {0: [], 1: [], 2: []}), (1, {0: ["jump"], 1: ["up"], 2: ["jump"]}), (2, {0: ["jump", "jump"], 1: ["up", "jump"], 2: ["jump", "up"]})):
        got = {n_of[bytes(r.key)]: [tid[x.tid] for x in r.path] for r in leads_to(e, starts, op("eq", n, lit(3)), steps).collect()}
        assert got == want


def test_ways_to_roots(spark):
    rng = random.Random(7)
    parent = {0: None, **{i: i - 1 if i < 300 else rng.randrange(i) for i in range(1, 400)}}
    depth = {0: 0}
    for i in range(1, 400):
        depth[i] = depth[parent[i]] + 1
    rows = spark.createDataFrame([(i, p, depth[i]) for i, p in parent.items()], "key int, parent int, depth int")
    targets = [0, 5, 299, 350, 399, 1000]
    got = traces.root_paths(rows, spark.createDataFrame([(t,) for t in targets + [5]], "key int")).collect()
    want = set()
    for t in targets[:-1]:
        at, back = t, 0
        while at is not None:
            want.add((t, back, at, parent[at], depth[at]))
            at, back = parent[at], back + 1
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "key int, parent int")
    with pytest.raises(ValueError):
        traces.root_paths(ring, spark.createDataFrame([(0,)], "key int"))


def test_forest_keeps_the_least_parent(spark):
    edges = random_edges(30, 60, 9)
    g = graph(spark, edges)
    got = {r.key: (r.depth, r.parent) for r in traces.forest(g.edges, spark.createDataFrame([("n01",), ("n02",)], "key string")).collect()}
    depth, layer = {"n01": 0, "n02": 0}, ["n01", "n02"]
    while layer:
        new = {v for u, v in edges if u in layer and v not in depth}
        depth |= dict.fromkeys(new, depth[layer[0]] + 1)
        layer = sorted(new)
    assert got == {k: (d, None if d == 0 else min(u for u, v in edges if v == k and depth.get(u) == d - 1)) for k, d in depth.items()}


def test_steps_of_recorded_rows(spark):
    rows = spark.createDataFrame([("a", 1, "on"), ("a", 2, "off"), ("a", 3, "off"), ("b", 1, "off"), ("b", 2, "on"), ("b", 3, "odd")], "who string, t int, what string")
    m = row_model("lamp", {"state": {"kind": "enum", "values": ["on", "off"]}}, transitions={"on": "user", "off": "env"})
    e = observed.recorded(rows, ["who"], ["t"], m, {"state": F.col("what")}, F.col("what"))
    ids = [t["id"] for t in m.sorted_transitions]
    assert sorted((r.who, r.tick, None if r.tid is None else ids[r.tid], r.pre_s[0], r.post_s[0]) for r in e.collect() if r.tid is not None) == [("a", 2, "off", "on", "off"), ("a", 3, "off", "off", "off"), ("b", 2, "on", "off", "on")]
    assert e.where("tid is null").count() == 1
    assert [(r.who, r.tick) for r in e.where(Steps(m).matches(step_changed_to("state", "on"))).collect()] == [("b", 2)]
