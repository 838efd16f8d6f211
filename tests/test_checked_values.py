"""Validation by path, inferred domains and bisimulation, against brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import inference, validation
from tidegraph.operators import bisimulation
from tidegraph.sources.rows import row_model

INT, SET = {"kind": "boundedInt", "min": -1, "max": 3}, {"kind": "intSet", "values": [2, 5]}
ENUM = {"kind": "enum", "values": ["a", "b"]}
DOMAINS = [
    {"kind": "bool"}, INT, SET, ENUM, {"kind": "tokens", "count": 2}, {"kind": "lengthCat"}, {"kind": "option", "inner": INT},
    {"kind": "boundedList", "inner": {"kind": "boundedList", "inner": ENUM, "maxLen": 2}, "maxLen": 2},
    {"kind": "record", "fields": {"x": INT, "y": {"kind": "option", "inner": ENUM}, "z": {"kind": "record", "fields": {}}}},
    {"kind": "tagged", "tag": "t", "variants": {"p": {"kind": "record", "fields": {"n": INT}}, "q": {"kind": "record", "fields": {"t": ENUM, "m": {"kind": "bool"}}}, "r": {"kind": "bool"}}},
]
GONE = object()


def problems(d, v, path="$"):
    if v == "__unmounted__":
        return []
    kind, one = d["kind"], lambda reason, at=path: [(at, reason)]
    if kind == "option" and v is None:
        return []
    if kind == "option":
        return problems(d["inner"], v, path) if v != "__unmounted__" else []
    if v is GONE:
        return one("missing")
    if kind == "bool":
        return [] if isinstance(v, bool) else one("not a boolean")
    if kind in ("boundedInt", "intSet"):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v):
            return one("not an integer")
        if kind == "intSet":
            return [] if v in d["values"] else one("not one of the integers")
        return one(f"below {d['min']}") if v < d["min"] else one(f"above {d['max']}") if v > d["max"] else []
    if kind in ("enum", "tokens", "lengthCat"):
        values = d.get("values") or (["tok1", "tok2"] if kind == "tokens" else ["0", "1", "many"])
        return one("not a string") if not isinstance(v, str) else [] if v in values else one("not one of the values")
    if kind == "boundedList":
        if not isinstance(v, list):
            return one("not a list")
        return one(f"longer than {d['maxLen']}") if len(v) > d["maxLen"] else [p for i, x in enumerate(v) for p in problems(d["inner"], x, f"{path}[{i}]")]
    if not isinstance(v, dict):
        return one("not an object")
    fields = d.get("fields")
    if kind == "tagged":
        tag = v.get(d["tag"], GONE)
        if tag is GONE:
            return one("missing", f"{path}.{d['tag']}")
        if tag not in d["variants"] or not isinstance(tag, str):
            return one("not one of the variants", f"{path}.{d['tag']}")
        fields = {k: x for k, x in d["variants"][tag].get("fields", {}).items() if k != d["tag"]}
    return [p for k in sorted(fields) for p in problems(fields[k], v.get(k, GONE), f"{path}.{k}")]


def some_value(rng, depth=0):
    kinds = ["int", "text", "bool", "null", "big"] + (["list", "dict", "dict", "tagged"] if depth < 3 else [])
    kind = rng.choice(kinds)
    if kind == "int":
        return rng.randint(-3, 6)
    if kind == "big":
        return rng.choice([10**12, 1.5, 2.0, -(10**20)])
    if kind == "text":
        return rng.choice(["a", "b", "c", "tok1", "0", "many", "", "__unmounted__"])
    if kind == "list":
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == "dict":
        return {k: some_value(rng, depth + 1) for k in "xyz" if rng.random() < 0.8}
    if kind == "tagged":
        return {"t": rng.choice(["p", "q", "r", "s", 1]), "n": some_value(rng, 3), "m": some_value(rng, 3)}
    return rng.choice([True, False]) if kind == "bool" else None


@pytest.mark.parametrize("n", range(len(DOMAINS)))
def test_json_values(spark, n):
    rng = random.Random(n)
    values = [some_value(rng) for _ in range(150)] + [{"x": 1, "y": None, "z": {}}, {"x": 9, "y": "q", "z": 1, "more": 1}, {"t": "p", "n": 3}, {"t": "r"}, [["a", "c"], [1], []][:2]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, text string")
    got = {r.id: [tuple(p) for p in r.p] for r in rows.select("id", validation.violations(DOMAINS[n], validation.json_variant(F.col("text"))).alias("p")).collect()}
    assert got == {i: problems(DOMAINS[n], v) for i, v in enumerate(values)}


def test_typed_values_and_text_that_is_not_json(spark):
    rows = spark.createDataFrame([(1, "a", [1, 9]), (None, "z", None)], "x int, y string, l array<int>")
    d = {"kind": "record", "fields": {"x": INT, "y": ENUM, "l": {"kind": "boundedList", "inner": INT, "maxLen": 2}}}
    got = rows.select(validation.violations(d, validation.variant(F.struct("x", "y", "l"), "struct")).alias("p")).collect()
    assert [tuple(p) for p in got[0].p] == [("$.l[1]", "above 3")]
    assert {p.path for p in got[1].p} == {"$.l", "$.x", "$.y"}
    bad = spark.createDataFrame([("{",), (None,)], "t string").select(validation.violations(INT, validation.json_variant(F.col("t"))).alias("p")).collect()
    assert [[tuple(p) for p in r.p] for r in bad] == [[("$", "missing")]] * 2


def read(v):
    return {"kind": "read", "var": v}


def op(kind, *args):
    return {"kind": kind, "args": [a if isinstance(a, dict) else {"kind": "lit", "value": a} for a in args]}


def test_inferred_domains():
    m = row_model("m", {"a": {"kind": "boundedInt", "min": -2, "max": 4}, "b": SET, "w": {"kind": "boundedInt", "min": 0, "max": 500}, "e": ENUM, "r": {"kind": "record", "fields": {"n": INT}}})
    exprs = [op("add", read("a"), read("b")), op("sub", read("b"), read("a")), op("mod", read("a"), read("b")), op("mod", read("w"), -7), op("add", read("w"), read("w")), op("sub", read("w"), read("b")), op("cond", True, read("a"), op("add", read("b"), 90)), op("add", op("mod", read("a"), 2), read("b")), op("mod", read("a"), read("a"))]
    domains = {"a": range(-2, 5), "b": [2, 5], "w": range(501)}

    def run(e, env):
        if e["kind"] == "lit":
            return e["value"]
        if e["kind"] == "read":
            return env[e["var"]]
        if e["kind"] == "cond":
            return [run(x, env) for x in e["args"][1:]]
        x, y = (run(a, env) for a in e["args"])
        return x + y if e["kind"] == "add" else x - y if e["kind"] == "sub" else x % abs(y) if y else None

    for e in exprs:
        values = set()
        for c in itertools.product(*domains.values()):
            v = run(e, dict(zip(domains, c, strict=True)))
            values |= set(v if isinstance(v, list) else [v]) - {None}
        d = inference.infer(m, e)
        holds = inference.values_of(d)
        if holds is None:
            assert d["min"] <= min(values) and max(values) <= d["max"]
        else:
            assert values <= set(holds)
        if inference.is_exact(m, e):
            assert values == set(holds)
    assert inference.infer(m, read("e")) is None and inference.infer(m, op("add", read("e"), 1)) is None and inference.infer(m, op("mod", read("a"), 0)) is None
    assert inference.infer(m, op("add", {"kind": "read", "var": "r", "path": ["n"]}, 1)) == {"kind": "boundedInt", "min": 0, "max": 4}
    assert inference.infer(m, op("sub", read("b"), 0)) == {"kind": "intSet", "values": [2, 5]}


def partition(nodes, edges):
    c = dict(nodes)
    while True:
        new = {k: (c[k], frozenset((lab, c[v]) for u, v, lab in edges if u == k)) for k in c}
        if len(set(new.values())) == len(set(c.values())):
            return c
        c = {k: sorted(set(new.values()), key=repr).index(v) for k, v in new.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bisimulation(spark, seed):
    rng = random.Random(seed)
    nodes = [(i, rng.choice("pq")) for i in range(40)]
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice("xy")) for _ in range(35)]
    n, e = spark.createDataFrame(nodes, "key int, label string"), spark.createDataFrame(edges, "pre int, post int, label string")
    c = partition(nodes, edges)
    got = {r["key"]: (r["class"], r["size"]) for r in bisimulation.classes(n, e).collect()}
    assert got == {k: (min(x for x in c if c[x] == c[k]), sum(c[x] == c[k] for x in c)) for k in c}
    # A copy under other keys behaves alike; one more step sets its states apart.
    copy = n.select((F.col("key") + 100).alias("key"), "label"), e.select((F.col("pre") + 100).alias("pre"), (F.col("post") + 100).alias("post"), "label")
    assert bisimulation.differing((n, e), copy).collect() == []
    more = copy[1].unionByName(spark.createDataFrame([(100, 100, "new")], "pre int, post int, label string"))
    assert (2, 100) in {tuple(r) for r in bisimulation.differing((n, e), (copy[0], more)).collect()}
