"""check(): verdicts of properties on a model, each with a trace where there is one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.exprs import Scope, true
from tidegraph.model import Model
from tidegraph.operators import ctl
from tidegraph.operators.explore import Explorer, Graph, Limits, explore
from tidegraph.operators.steps import leads_to, step_violations, triggers
from tidegraph.operators.traces import replayable, trace_ids
from tidegraph.plans.slicing import groups

VERDICTS = "property string, status string, boundedness string, message string, replayable boolean, trace array<string>"


@dataclass
class CheckResult:
    verdicts: list[dict]
    stats: tuple[int, int, int]
    vacuity: list[str] = field(default_factory=list)
    bound_hits: list[str] = field(default_factory=list)

    def of(self, name: str) -> dict:
        return next(v for v in self.verdicts if v["property"] == name)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(v.get(c.split()[0]) for c in VERDICTS.split(", ")) for v in self.verdicts], VERDICTS)


def mount_injected(model: Model, formula: dict, reads: set[str], witness: bool = False) -> dict:
    """Atoms hold safely where what they read is not mounted (or fail, in a formula that seeks a witness)."""
    guards = [g for g in (model.mount_guard(model.var(r)) for r in sorted(reads)) if g is not None]
    if not guards:
        return formula
    kind = formula["kind"]
    if kind == "atom":
        there = {"kind": "and", "args": guards}
        p = formula["predicate"]
        return ctl.atom({"kind": "and", "args": [there, p]} if witness else {"kind": "or", "args": [{"kind": "not", "args": [there]}, p]})
    flip = witness != (kind == "fnot")
    flip = True if kind in ("EF", "EX", "EG", "EU") else flip
    return {**formula, **{k: mount_injected(model, formula[k], reads, flip) for k in ("arg", "left", "right") if k in formula}, **({"args": [mount_injected(model, x, reads, flip) for x in formula["args"]]} if "args" in formula else {})}


def temporal_verdict(graph: Graph, g: ctl.Graph, prop: dict, trace_mode: str = "nearest", fairness: str = "reference") -> dict:
    states = graph.states

    def atom(p: dict) -> DataFrame:
        return states.where(true(Scope(graph.model, F.col("s")).eval(p))).select("key")

    fair = [g.label(c["condition"], atom) for c in prop.get("fairness") or ()]
    sat, name, kind = g.label(prop["formula"], atom, fair or None, fairness == "strict"), prop["name"], prop["formula"]["kind"]
    failing = graph.initial.select("key").join(sat, "key", "left_anti")
    first = failing.agg(F.min("key")).first()[0]
    if first is None:
        return {"property": name, "status": "verified" if graph.exhausted else "verified-within-bounds", "boundedness": "exhaustive" if graph.exhausted else "bounded"}
    if kind in ("EF", "EX", "EG", "EU"):
        said = {"EF": "nothing that was explored satisfies it", "EX": "no next state satisfies it", "EG": "no explored path keeps to it for ever", "EU": "no explored path gets there that way"}
        return {"property": name, "status": "vacuous-warning", "message": said[kind]}
    out = {"property": name, "status": "violated", "trace": [], "replayable": kind not in ("AX", "AF", "AU")}
    if kind == "AG":
        if trace_mode == "nearest":  # the nearest state that breaks the inner formula, not just the failing start
            bad = g.without(g.label(prop["formula"]["arg"], atom)).join(states.select("key", "depth"), "key")
            nearest = bad.agg(F.min(F.struct("depth", "key")).alias("m")).first().m
            out["trace"] = trace_ids(graph, nearest.key)
        out["replayable"] = replayable(graph.model, out["trace"])
    return out


def step_verdict(graph: Graph, prop: dict) -> dict:
    bad = step_violations(graph, prop).join(graph.states.select(F.col("key").alias("pre"), "depth"), "pre")
    first = bad.agg(F.min(F.struct("depth", "pre", "tid", "post")).alias("m")).first().m
    if first is None:
        return {"property": prop["name"], "status": "verified-within-bounds"}
    ids = [*trace_ids(graph, first.pre), graph.model.sorted_transitions[first.tid]["id"]]
    return {"property": prop["name"], "status": "violated", "trace": ids, "replayable": replayable(graph.model, ids)}


def response_verdict(explorer: Explorer, graph: Graph, prop: dict) -> dict:
    fired, budget = triggers(graph, prop), prop.get("budget") or {}
    if fired.isEmpty():
        return {"property": prop["name"], "status": "vacuous-warning", "message": "no explored step is a trigger"}
    steps = budget.get("steps", budget.get("environment", 0)) or 0
    missed = leads_to(explorer, fired.select(F.col("post").alias("key"), F.col("post_s").alias("s")), prop["goal"], steps, bool(prop.get("allowUserEvents")))
    found = fired.join(graph.states.select(F.col("key").alias("pre"), "depth"), "pre").join(missed.withColumnRenamed("key", "post"), "post")
    first = found.agg(F.min_by(F.struct("pre", "tid", F.transform("path", lambda x: x.tid).alias("rest")), F.struct("depth", "pre", "tid", "post")).alias("m")).first().m
    if first is None:
        return {"property": prop["name"], "status": "verified-within-bounds"}
    rules = graph.model.sorted_transitions
    ids = [*trace_ids(graph, first.pre), rules[first.tid]["id"], *(rules[i]["id"] for i in first.rest)]
    return {"property": prop["name"], "status": "violated", "trace": ids, "replayable": replayable(graph.model, ids)}


def vacuity(graph: Graph) -> list[str]:
    """Transitions that were never enabled and enum values that no state has."""
    m = graph.model
    ran = {r.tid for r in graph.edges.select("tid").distinct().collect()} | {i for i, t in enumerate(m.sorted_transitions) if t["cls"] == "internal"}
    open_ = _enabled(graph)
    out = [f"transition never enabled: {t['id']}" for i, t in enumerate(m.sorted_transitions) if i not in ran and i not in open_]
    enums = [(i, v) for i, v in enumerate(m.vars) if v["domain"]["kind"] == "enum"]
    if enums:
        seen = graph.states.agg(*(F.collect_set(F.col(f"s.v{i}")).alias(f"e{i}") for i, _ in enums)).first()  # at most the enum's values
        out += [f"enum value never inhabited: {v['id']}={x}" for i, v in enums for x in v["domain"]["values"] if x not in seen[f"e{i}"]]
    return sorted(out)


def _enabled(graph: Graph) -> set[int]:
    rules = list(enumerate(graph.model.sorted_transitions))
    if not rules:
        return set()
    row = graph.states.agg(*(F.bool_or(Scope(graph.model, F.col("s")).enabled(t)).alias(f"t{i}") for i, t in rules)).first()
    return {i for i, _ in rules if row[f"t{i}"]}


def bound_hits(graph: Graph) -> list[str]:
    """Transitions still enabled on the frontier that the depth bound cut off."""
    rules = [(i, t) for i, t in enumerate(graph.model.sorted_transitions) if t["cls"] != "internal"]
    if graph.exhausted or not rules:
        return []
    row = graph.frontier.agg(*(F.bool_or(Scope(graph.model, F.col("s")).enabled(t)).alias(f"t{i}") for i, t in rules)).first()
    return sorted(f"maxDepth reached before {t['id']}" for i, t in rules if row[f"t{i}"])


def dominant_vars(graph: Graph, top: int = 5) -> DataFrame:
    """(var, values): the variables with the most distinct values."""
    m = graph.model
    row = graph.states.agg(*(F.count_distinct(F.to_json(F.struct(F.col(f"s.v{i}")))).alias(f"n{i}") for i in range(len(m.vars))))
    pairs = F.explode(F.array(*(F.struct(F.lit(v["id"]).alias("var"), F.col(f"n{i}").alias("values")) for i, v in enumerate(m.vars))))
    return row.select(pairs.alias("p")).select("p.*").orderBy(F.desc("values"), "var").limit(top)


def check(spark: SparkSession, model: Model, props: list[dict], limits: Limits | None = None, slicing: bool = False, trace_mode: str = "nearest", fairness: str = "reference", starts: DataFrame | None = None) -> CheckResult:
    verdicts, totals, warned, hits = {}, [], [], []
    for part, own in groups(model, props) if slicing else [(model, props)]:
        explorer = Explorer(spark, part, starts)
        graph = explorer.run(limits)
        totals.append(graph.stats)
        if graph.stopped:
            for p in own:
                verdicts[p["name"]] = {"property": p["name"], "status": "error", "message": f"search stopped at {graph.stopped}"}
            continue
        g = ctl.Graph.stored(graph.states, graph.edges) if any(p["kind"] == "temporal" for p in own) else None
        for p in own:
            if p["kind"] == "temporal":
                formula = p["formula"] if p.get("includeUnmounted") else mount_injected(part, p["formula"], {r for r in p.get("reads") or () if r in part.index})
                verdicts[p["name"]] = temporal_verdict(graph, g, {**p, "formula": formula}, trace_mode, fairness)
            elif p["kind"] == "alwaysStep":
                verdicts[p["name"]] = step_verdict(graph, p)
            else:
                verdicts[p["name"]] = response_verdict(explorer, graph, p)
        warned += vacuity(graph)
        hits += bound_hits(graph) + graph.bound_hits
    total = tuple(map(sum, zip(*((s, e, 0) for s, e, _ in totals), strict=True))) if totals else (0, 0, 0)
    depth = max((d for *_, d in totals), default=0)
    return CheckResult([verdicts[p["name"]] for p in props], (total[0], total[1], depth), sorted(set(warned)), sorted(set(hits)))


CONFIDENCE = ("exact", "property-preserving", "bounded", "over-approx", "manual", "heuristic")  # fixed values, best first


def confidence(model: Model, verdict: dict) -> str:
    """The weakest of what a verdict rests on: the transitions' own confidence, reductions, and bounds."""
    marks = [t.get("confidence", "exact") for t in model.transitions] + [r["claim"] for r in (model.metadata.get("numericReductions") or {}).get("reductions", ())]
    if verdict.get("boundedness") == "bounded" or verdict["status"] == "verified-within-bounds":
        marks.append("bounded")
    return max(marks, key=CONFIDENCE.index, default="exact")


def always(name: str, predicate: dict, **more) -> dict:
    return {"kind": "temporal", "name": name, "formula": ctl.AG(ctl.atom(predicate)), **more}


def reachable(name: str, predicate: dict, **more) -> dict:
    return {"kind": "temporal", "name": name, "formula": ctl.EF(ctl.atom(predicate)), **more}


def reachable_from(name: str, when: dict, goal: dict, **more) -> dict:
    return {"kind": "temporal", "name": name, "formula": ctl.AG(ctl.implies(ctl.atom(when), ctl.EF(ctl.atom(goal)))), **more}


def temporal(name: str, formula: dict, **more) -> dict:
    return {"kind": "temporal", "name": name, "formula": formula, **more}


def always_step(name: str, predicate: dict, **more) -> dict:
    return {"kind": "alwaysStep", "name": name, "predicate": predicate, **more}


def leads_to_within(name: str, trigger: dict, goal: dict, steps: int, **more) -> dict:
    return {"kind": "leadsToWithin", "name": name, "trigger": trigger, "goal": goal, "budget": {"steps": steps}, **more}


def compare_models(spark: SparkSession, a: Model, b: Model, props: list[dict], limits: Limits | None = None) -> dict:
    """Whether two models over the same variables reach the same states and give the same verdicts."""
    ga, gb = explore(spark, a, limits), explore(spark, b, limits)
    only_a = ga.states.select("key").exceptAll(gb.states.select("key")).count()
    only_b = gb.states.select("key").exceptAll(ga.states.select("key")).count()
    va, vb = check(spark, a, props, limits), check(spark, b, props, limits)
    changed = [x["property"] for x, y in zip(va.verdicts, vb.verdicts, strict=True) if x["status"] != y["status"]]
    return {"onlyFirst": only_a, "onlySecond": only_b, "changedVerdicts": changed, "same": not (only_a or only_b or changed)}
