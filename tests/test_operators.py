"""Operators against small independent computations."""


import random

import pytest
from models import BOOL, dequeue, diamond, enqueue, enum, eq, lit, loop, model, op, put, queue, read, rule, seq, toggles, var, when
from pyspark.sql import functions as F

from tidegraph.functions import abstraction
from tidegraph.functions import domains as dom
from tidegraph.functions.exprs import Scope
from tidegraph.model import ModelError, apply_overlay, canonical_json, parse_model
from tidegraph.operators import ctl
from tidegraph.operators.effects import Effects, state_row
from tidegraph.operators.explore import Explorer, explore, successors
from tidegraph.operators.traces import compare_steps, diff, random_walks, trace_ids
from tidegraph.plans.check import always, check, confidence, dominant_vars, reachable
from tidegraph.plans.slicing import compare_economics, contributors, prune_fields, slice_model
from tidegraph.sources import artifacts, builders, tla
from tidegraph.streaming import monitor

INT9 = {"kind": "boundedInt", "min": 0, "max": 9}


# -- temporal operators against brute force on random graphs

def brute(n, edges, kind, p, q=frozenset()):
    succ = {i: {b for a, b in edges if a == i} for i in range(n)}
    everything = set(range(n))

    def eu(p, q):
        s = set(q)
        while more := {a for a in everything - s if a in p and succ[a] & s}:
            s |= more
        return s

    def eg(p):
        s = set(p)
        while gone := {a for a in s if not succ[a] & s}:
            s -= gone
        return s

    p, q = set(p), set(q)
    return {
        "ex": lambda: {a for a in everything if succ[a] & p}, "ax": lambda: {a for a in everything if succ[a] <= p}, "ef": lambda: eu(everything, p),
        "ag": lambda: everything - eu(everything, everything - p), "eg": lambda: eg(p), "af": lambda: everything - eg(everything - p), "eu": lambda: eu(p, q),
        "au": lambda: everything - (eu(everything - q, everything - p - q) | eg(everything - q)),
    }[kind]()


def test_ctl_on_random_graphs(spark):
    """Twelve graphs at once: their keys carry the graph's number, and no edge joins two."""
    rng, n, nodes, edges, sets = random.Random(4), 7, [], [], {}
    for g in range(12):
        nodes += [(f"{g}.{i}",) for i in range(n)]
        e = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(4, 12))}
        edges += [(f"{g}.{a}", f"{g}.{b}") for a, b in e]
        sets[g] = (e, {i for i in range(n) if rng.random() < 0.6}, {i for i in range(n) if rng.random() < 0.3})
    graph = ctl.Graph.stored(spark.createDataFrame(nodes, "key string"), spark.createDataFrame(edges, "pre string, post string"))
    frame = lambda k: spark.createDataFrame([(f"{g}.{i}",) for g, s in sets.items() for i in s[k]], "key string")
    p, q = frame(1), frame(2)
    for kind in ("ex", "ax", "ef", "ag", "eg", "af", "eu", "au"):
        got = {r.key for r in (getattr(graph, kind)(p, q) if kind in ("eu", "au") else getattr(graph, kind)(p)).collect()}
        assert got == {f"{g}.{i}" for g, (e, a, b) in sets.items() for i in brute(n, e, kind, a, b)}, kind


def test_fair_eg_reference_and_strict(spark):
    graph = ctl.Graph(spark.createDataFrame([(0,), (1,)], "key int"), spark.createDataFrame([(0, 0), (0, 1)], "pre int, post int"))
    every, fair = graph.nodes, [graph.nodes.where("key = 1")]
    assert {r.key for r in graph.eg_fair(every, fair).collect()} == {0}
    assert graph.eg_fair(every, fair, strict=True).count() == 0


# -- expressions and effects

def evaluate(spark, variables, values, *exprs):
    m = model("m", variables, [], 0)
    row = spark.range(1).select(state_row(m, values).alias("s"))
    return list(row.select(*(Scope(m, F.col("s")).eval(e).col.alias(f"c{i}") for i, e in enumerate(exprs))).first())


def test_expressions(spark):
    variables = [var("n", INT9, 0), var("t", BOOL, True), var("l", {"kind": "boundedList", "inner": INT9, "maxLen": 3}, []), var("r", {"kind": "record", "fields": {"a": INT9, "b": {"kind": "option", "inner": enum("x")}}}, {"a": 1, "b": None}), var("k", {"kind": "tokens", "count": 2}, "tok1")]
    values = {"n": 7, "t": True, "l": [4, 5], "r": {"a": 1, "b": None}, "k": "tok1"}
    got = evaluate(
        spark, variables, values,
        op("eq", read("n"), "7"), op("eq", read("r", "b"), lit(None)), op("eq", read("r"), lit({"a": 1, "b": None})), op("not", read("n")), op("and"), op("or"),
        op("mod", op("sub", 0, 3), -5), op("mod", 3, 0), op("add", read("t"), 1), op("lt", read("t"), 1), read("l", "1"), read("l", "9"), read("l", "zzz"), read("n", "deep"),
        {"kind": "lenCat", "arg": read("l")}, {"kind": "lenCat", "arg": read("n")}, {"kind": "freshToken", "domainOf": "k"}, {"kind": "updateField", "target": read("l"), "path": ["3"], "value": lit(9)},
        {"kind": "updateField", "target": read("r"), "path": ["a"], "value": lit(8)}, op("cond", read("n"), 1, 2), {"kind": "readPre", "var": "n"}, {"kind": "readOpArg", "key": "x"}, op("add", 9223372036854775807, 1),
    )
    assert got[:17] == [False, True, True, True, True, False, 2, None, None, False, 5, None, 4, None, "many", "0", "tok2"]
    assert got[17:] == [[4, 5, None, 9], (8, None), 2, None, None, None]


@pytest.mark.parametrize("policy, raw, want", [("forbid", 8, []), ("forbid", 3, [3]), ("wrap", 8, [2]), ("saturate", 8, [7]), ("saturate", -1, [1]), ("wrap", -1, [7])])
def test_overflow(spark, policy, raw, want):
    m = model("m", [var("n", {"kind": "boundedInt", "min": 1, "max": 7, "overflow": policy}, 1)], [], 0)
    row = spark.range(1).select(state_row(m, {"n": 1}).alias("s"))
    out = row.select(Effects(m).apply(put("n", raw), F.col("s"), F.col("s")).alias("o")).first().o
    assert [x.v0 for x in out] == want


@pytest.mark.parametrize("policy, raw, want", [("forbid", 1, []), ("wrap", 3, [2]), ("saturate", 1, [2]), ("saturate", -4, [0]), ("forbid", 2, [2])])
def test_int_sets(spark, policy, raw, want):
    m = model("m", [var("n", {"kind": "intSet", "values": [0, 2], "overflow": policy}, 0)], [], 0)
    row = spark.range(1).select(state_row(m, {"n": 0}).alias("s"))
    out = row.select(Effects(m).apply(put("n", raw), F.col("s"), F.col("s")).alias("o")).first().o
    assert [x.v0 for x in out] == want


def test_queues_and_operation_arguments(spark):
    variables = [queue(["A"], {"x": INT9}, 2), var("n", INT9, 3), var("got", INT9, 0)]
    rules = [rule("add", op("lt", read("n"), 5), seq(enqueue("A", x=read("n")), put("n", op("add", read("n"), 1)))), rule("take", eq(read("sys:pending", "0", "opId"), "A"), seq(dequeue(), put("got", {"kind": "readOpArg", "key": "x"})))]
    g = explore(spark, model("q", variables, rules, 6, 2))
    states = {(tuple(o.args.x for o in r.s.v0), r.s.v1, r.s.v2) for r in g.states.collect()}
    seen, frontier = set(), {((), 3, 0)}
    while frontier:
        seen |= frontier
        frontier = {s for q, n, got in frontier for s in ([((*q, n), n + 1, got)] if n < 5 and len(q) < 2 else []) + ([(q[1:], n, q[0])] if q else [])} - seen
    assert states == seen and g.exhausted


def test_mount_scopes(spark):
    local = var("draft", enum("empty", "full"), ["empty", "full"])
    local["scope"] = {"kind": "mount-local", "id": "form", "when": eq(read("route"), "form")}
    m = model("mount", [var("route", enum("home", "form"), "home"), local], [rule("go", eq(read("route"), "home"), put("route", "form")), rule("leave", eq(read("route"), "form"), put("route", "home")), rule("fill", eq(read("draft"), "empty"), put("draft", "full"), reads=["draft"], writes=["draft"])], 5)
    g = explore(spark, m)
    assert {(r.s.v0, r.s.v1, r.s.u1) for r in g.states.collect()} == {("home", None, True), ("form", "empty", False), ("form", "full", False)}
    assert explore(spark, m, max_depth=0).n_states == 1
    away = evaluate(spark, [var("route", enum("home", "form"), "home"), local], {"route": "home", "draft": dom.UNMOUNTED}, eq(read("draft"), dom.UNMOUNTED), eq(read("draft"), lit(None)), eq(read("draft"), "empty"))
    assert away == [True, False, False]
    r = check(spark, m, [always("kept", op("not", eq(read("draft"), "full")), reads=["draft"]), reachable("full", eq(read("draft"), "full"), reads=["draft"])])
    assert r.of("kept")["trace"] == ["go"] and r.of("full")["status"].startswith("verified")


def test_internal_transitions(spark):
    variables = [var("a", INT9, 0), var("b", INT9, 0), var("c", INT9, 0)]
    rules = [rule("tick", op("lt", read("a"), 2), put("a", op("add", read("a"), 1))), rule("copy", op("neq", read("b"), read("a")), put("b", read("a")), "internal", {"kind": "internal", "text": ""}, triggeredBy=["a"], writes=["b"]), rule("double", op("neq", read("c"), op("add", read("b"), read("b"))), put("c", op("add", read("b"), read("b"))), "internal", {"kind": "internal", "text": ""}, triggeredBy=["b"], writes=["c"])]
    g = explore(spark, model("int", variables, rules, 5, 0, 4))
    assert {tuple(r.s) for r in g.states.collect()} == {(0, 0, 0), (1, 1, 2), (2, 2, 4)} and g.n_edges == 2
    # Two that write the same variable run in all orders, or by phase.
    both = lambda **p: [rule("go", eq(read("a"), 0), put("a", 1)), rule("x", eq(read("a"), 1), put("b", 1), "internal", {"kind": "internal", "text": ""}, triggeredBy=["a"], writes=["b"], **p.get("x", {})), rule("y", eq(read("a"), 1), put("b", 2), "internal", {"kind": "internal", "text": ""}, triggeredBy=["a"], writes=["b"], **p.get("y", {}))]
    ends = lambda rules: {r.s.v1 for r in explore(spark, model("c", variables, rules, 3)).states.where("depth = 1").collect()}
    assert ends(both()) == {1, 2}
    assert ends(both(x={"phase": 2}, y={"phase": 1})) == {1}
    # What does not come to rest has no successors.
    spin = [rule("go", eq(read("a"), 0), put("a", 1)), rule("spin", eq(read("a"), 1), put("b", op("mod", op("add", read("b"), 1), 5)), "internal", {"kind": "internal", "text": ""}, writes=["b"])]
    assert explore(spark, model("s", variables, spin, 3)).n_states == 1


def test_token_symmetry(spark):
    t = {"kind": "tokens", "count": 3}
    m = model("tok", [var("a", {"kind": "option", "inner": t}, None), var("b", {"kind": "option", "inner": t}, None)], [rule("a", lit(True), {"kind": "havoc", "var": "a"}), rule("b", lit(True), {"kind": "havoc", "var": "b"})], 4)
    assert explore(spark, m).n_states == 5  # none, a, b, both the same, both different
    fresh = model("fresh", [var("a", t, "tok1"), var("b", t, "tok1"), var("c", t, "tok1")], [rule("f", lit(True), put("b", {"kind": "freshToken", "domainOf": "a"})), rule("g", lit(True), put("c", {"kind": "freshToken", "domainOf": "a"}))], 3)
    assert {r.transition for r in explore(spark, fresh).edges.select(F.col("tid").alias("transition")).distinct().collect()} == {0, 1}


def test_generated_models_against_an_interpreter(spark):
    """Flags, modes and a counter with havoc, choose, if and seq, against plain enumeration."""
    for i in range(4):
        variables = [var("flag", BOOL, i % 3 == 0), var("mode", enum("a", "b", "c"), "a"), var("n", {"kind": "boundedInt", "min": 0, "max": 3, "overflow": ("forbid", "wrap", "saturate")[i % 3]}, 0)]
        rules = [rule("set", op("not", read("flag")), put("flag", True)), rule("choose", read("flag"), {"kind": "choose", "var": "mode", "among": [lit("b"), lit("c")]}), rule("branch", eq(read("mode"), "b"), when(read("flag"), put("n", op("add", read("n"), 2)), {"kind": "havoc", "var": "flag"})), rule("both", eq(read("mode"), "c"), seq({"kind": "havoc", "var": "flag"}, put("n", op("add", read("n"), 1))))]

        def grow(n, by, i=i):
            x = n + by
            return [x] if x <= 3 else [[], [x % 4], [3]][i % 3]

        def step(s):
            f, m, n = s
            out = [] if f else [(True, m, n)]
            out += [(f, "b", n), (f, "c", n)] if f else []
            if m == "b":
                out += [(f, m, x) for x in grow(n, 2)] if f else [(False, m, n), (True, m, n)]
            if m == "c":
                out += [(h, m, x) for h in (False, True) for x in grow(n, 1)]
            return out

        start = (i % 3 == 0, "a", 0)
        seen, frontier, edges = {start}, {start}, 0
        for _ in range(4):
            made = [t for s in frontier for t in step(s)]
            edges, frontier = edges + len(made), set(made) - seen
            seen |= frontier
        g = explore(spark, model("gen", variables, rules, 4))
        assert {tuple(r.s) for r in g.states.collect()} == seen and g.n_edges == edges


# -- traces, walks, reports

def test_traces_and_walks(spark):
    m = toggles(3)
    g = explore(spark, m)
    last = g.states.where("depth = 3").first()
    assert sorted(trace_ids(g, last.key)) == ["flip0", "flip1", "flip2"]
    d = g.edges.select(F.explode(diff(m, F.col("pre_s"), F.col("post_s"))).alias("d")).select("d.*").distinct().collect()
    assert {tuple(r) for r in d} == {(f"t{i}", "false", "true") for i in range(3)}
    walks = random_walks(Explorer(spark, loop()), 5, 4).collect()
    assert len(walks) == 20 and sorted(map(tuple, walks)) == sorted(map(tuple, random_walks(Explorer(spark, loop()), 5, 4).collect()))
    assert successors(spark, m, {"t0": True, "t1": False, "t2": False}).count() == 2
    assert dominant_vars(g, 2).collect()[0]["values"] == 2


def test_replayed_steps(spark):
    want = spark.createDataFrame([("x", 1, "a", "b"), ("x", 2, "b", "c"), ("y", 1, "a", "b"), ("y", 2, "b", "c"), ("z", 1, "a", "b")], "trace string, step int, pre string, post string")
    seen = spark.createDataFrame([("x", 1, "a", "b"), ("x", 2, "b", "c"), ("y", 1, "a", "q"), ("y", 2, "b", "c")], want.schema)
    assert {(r.trace, r.status, r.at_step) for r in compare_steps(want, seen).collect()} == {("x", "reproduced", None), ("y", "not-reproduced", 1), ("z", "inconclusive", None)}


def test_artifacts(spark, tmp_path):
    m = diamond()
    (tmp_path / "m.json").write_text(m.to_json())
    assert artifacts.read_models(spark, str(tmp_path / "m.json"))[0].to_json() == m.to_json()
    props = artifacts.parse_properties(canonical_json({"schemaVersion": 1, "properties": [always("x", read("a"))]}))
    r = check(spark, m, props)
    r.frame(spark).write.json(str(tmp_path / "report"))
    back = artifacts.read_report(spark, str(tmp_path / "report"))
    assert [tuple(x) for x in back.select("property", "status").collect()] == [("x", "violated")]
    assert artifacts.trust_diff(back, back).count() == 0 and confidence(m, r.of("x")) == "exact"
    with pytest.raises(ModelError):
        artifacts.parse_properties({"schemaVersion": 1, "properties": [{"kind": "temporal", "name": "x", "formula": {"kind": "XX"}}]})
    steps = spark.createDataFrame([("t", 1, "flipA", "p", "q")], artifacts.TRACE)
    artifacts.write_traces(steps, str(tmp_path / "traces"))
    assert artifacts.read_traces(spark, str(tmp_path / "traces")).count() == 1
    reg = artifacts.Registry()
    reg.group("g", lambda: reg.add({"name": "a"}))
    assert [p["name"] for p in reg.harvest()] == ["g/a"] and not reg.harvest()


def test_models_are_validated():
    raw = {"schemaVersion": 1, "id": "m", "vars": [var("a", BOOL, 3)], "transitions": [rule("t", read("zz"), put("yy", 1)), rule("t", lit(True), {"kind": "opaque", "ref": {}})], "bounds": {"maxDepth": -1}}
    with pytest.raises(ModelError) as e:
        parse_model(raw)
    for said in ("duplicate transition t", "initial value 3", "unknown variable zz", "unknown variable yy", "opaque", "bounds"):
        assert said in str(e.value)
    out = apply_overlay(loop(), {"ignoreVars": ["a"], "transitions": [rule("setTrue", lit(True), put("a", True))]})
    assert out.by_id["setTrue"]["guard"] == lit(True) and out.by_id["setFalse"]["effect"]["effects"] == []


# -- domains, slicing, abstraction, exports

def test_domains():
    opt = {"kind": "option", "inner": enum("x", "y")}
    rec = {"kind": "record", "fields": {"b": BOOL, "a": opt}}
    tag = {"kind": "tagged", "tag": "k", "variants": {"q": rec, "p": {"kind": "record", "fields": {}}}}
    lst = {"kind": "boundedList", "inner": BOOL, "maxLen": 2}
    for d in (BOOL, enum("a"), INT9, {"kind": "intSet", "values": [1, 5]}, opt, rec, tag, lst, {"kind": "tokens", "count": 3}, {"kind": "lengthCat"}):
        values = dom.enumerate_domain(d)
        assert len(values) == dom.cardinality(d) and all(dom.contains(d, v) for v in values)
    assert dom.enumerate_domain(tag)[0] == {"k": "p"} and dom.initial_values(lst, [True]) == [[True]] and dom.initial_values(BOOL, [True, False]) == [True, False]
    s = {"oneOf": [{"type": "object", "properties": {"k": {"const": "a"}}, "required": ["k"]}, {"type": "object", "properties": {"k": {"const": "b"}, "n": {"type": "integer", "minimum": 0, "maximum": 2}}, "required": ["k", "n"]}, {"type": "null"}]}
    assert dom.cardinality(dom.from_json_schema(s)) == 5


def test_slices_and_bits():
    m = toggles(4)
    part = slice_model(m, always("x", read("t1")))
    assert [v["id"] for v in part.vars] == ["t1"] and [t["id"] for t in part.transitions] == ["flip1"]
    e = compare_economics(m, part)
    assert (e["retainedBits"], e["prunedBits"], contributors(m)["totalBits"]) == (1.0, 3.0, 4.0)
    r = model("r", [var("r", {"kind": "record", "fields": {"a": BOOL, "b": BOOL}}, {"a": False, "b": False})], [rule("x", read("r", "a"), put("r", lit({"a": True, "b": True})))], 2)
    assert list(prune_fields(r, [always("x", read("r", "a"))]).vars[0]["domain"]["fields"]) == ["a"]


def test_abstraction(spark):
    rows = spark.createDataFrame([(None, None), (5, " "), (10, "12"), (99, "x"), (-3, "")], "n int, t string")
    got = rows.select(abstraction.interval(F.col("n"), [10, 50]).alias("i"), abstraction.saturated(F.col("n"), 12).alias("s"), abstraction.input_class(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(None, 0, "empty"), (0, 5, "blank"), (1, 10, "number"), (2, 13, "text"), (0, 0, "empty")]
    m = model("w", [var("n", INT9, 0)], [rule("up", op("lt", read("n"), 4), put("n", op("add", read("n"), 2)))], 3)
    assert abstraction.cut_points(m, "n") == [4] and abstraction.widened(m, "n") == {"kind": "boundedInt", "min": -6, "max": 10}
    assert abstraction.saturation_counter(INT9, 3)[0]["values"] == [0, 1, 2, 3, 4]


def test_generators_and_tla(spark):
    q = builders.pending_queue(["GET", "POST"], ["user#resolve", "save#resolve"], 2)
    v1, r1 = builders.cached_fetch("user", "GET", ["some"])
    v2, r2 = builders.mutation("save", "POST", ("user",))
    m = parse_model({"schemaVersion": 1, "id": "gen", "vars": [q, *v1, *v2], "transitions": [*r1, *r2], "bounds": {"maxDepth": 4, "maxPending": 2}})
    assert check(spark, m, [reachable("done", eq(read("save:status"), "success"))]).of("done")["status"].startswith("verified")
    nav = [rule(f"{k}", lit(True), builders.navigate(k, ["/", "/a"], to)) for k, to in (("push", "/a"), ("back", None), ("replace", "/"))]
    n = parse_model({"schemaVersion": 1, "id": "nav", "vars": builders.location(["/", "/a"], "/"), "transitions": nav, "bounds": {"maxDepth": 3}})
    states = {(r.s.v0, tuple(r.s.v1)) for r in explore(spark, n).states.collect()}
    assert {("/", ()), ("/a", ("/",)), ("/a", ("/", "/a")), ("/", ("/",))} <= states
    text = tla.module(diamond())
    assert "flipA ==" in text and "a' = TRUE /\\ UNCHANGED <<b>>" in text and "Next == flipA \\/ flipB" in text


def test_monitors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "e", 1.0), (2, "f", None)], "id int, kind string, value double")
    got = {(r.id, r.invariant, r.status) for r in monitor.monitor(rows, {"v": F.col("value") > 2, "k": F.col("kind") == "e", "h": None}).collect()}
    assert got == {(1, "v", "violated"), (1, "k", "ok"), (1, "h", "skipped"), (2, "v", "skipped"), (2, "k", "violated"), (2, "h", "skipped")}
    steps = [("u", 1, True, False), ("u", 2, False, False), ("u", 3, False, True), ("u", 4, True, False), ("u", 5, False, False), ("u", 6, False, False), ("w", 1, True, False)]
    spark.createDataFrame(steps, "entity string, tick long, trigger boolean, goal boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, tick long, trigger boolean, goal boolean").parquet(str(tmp_path / "in"))
    q = monitor.response_monitor(stream, 2).writeStream.format("memory").queryName("responses").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("responses").collect()) == [("u", 1, "met"), ("u", 4, "missed")]


