"""Transition models: typed variables, guarded nondeterministic effects, bounds. Small, read on the driver, and compiled
to Column expressions over one state struct."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from tidegraph.functions import domains as dom

QUEUE_ROLE = "pending-queue"
CLASSES = ("user", "nav", "env", "internal", "library")
EXPR_KINDS = frozenset("lit read eq neq and or not cond updateField tagIs lenCat freshToken transitionEnabled transitionEnabledPrefix readPre readOpArg lt lte gt gte add sub mod".split())
EFFECT_KINDS = frozenset("assign havoc choose if seq enqueue dequeue opaque".split())


class ModelError(ValueError):
    pass


def exprs_in(e: dict):
    """An expression and all expressions inside it."""
    yield e
    for x in e.get("args", ()) if isinstance(e.get("args"), (list, tuple)) else ():
        yield from exprs_in(x)
    for k in ("arg", "target", "value"):
        if isinstance(e.get(k), dict) and "kind" in e[k] and e["kind"] != "lit":
            yield from exprs_in(e[k])


def effects_in(e: dict):
    yield e
    for x in [*e.get("effects", ()), *(e[k] for k in ("then", "else") if k in e)]:
        yield from effects_in(x)


def exprs_of_effect(e: dict):
    for x in effects_in(e):
        for k in ("expr", "cond"):
            if k in x:
                yield from exprs_in(x[k])
        for y in x.get("among", ()):
            yield from exprs_in(y)
        if x["kind"] == "enqueue":
            for y in x.get("args", {}).values():
                yield from exprs_in(y)


@dataclass(frozen=True)
class Model:
    id: str
    vars: tuple[dict, ...]
    transitions: tuple[dict, ...]
    max_depth: int
    max_pending: int = 1
    max_internal_steps: int = 4
    metadata: dict = field(default_factory=dict)

    @cached_property
    def index(self) -> dict[str, int]:
        return {v["id"]: i for i, v in enumerate(self.vars)}

    @cached_property
    def sorted_transitions(self) -> tuple[dict, ...]:
        return tuple(sorted(self.transitions, key=lambda t: t["id"]))

    @cached_property
    def by_id(self) -> dict[str, dict]:
        return {t["id"]: t for t in self.transitions}

    def var(self, name: str) -> dict:
        if name not in self.index:
            raise ModelError(f"unknown variable {name}")
        return self.vars[self.index[name]]

    def mount_guard(self, var: dict) -> dict | None:
        scope = var.get("scope") or {"kind": "global"}
        return scope["when"] if scope["kind"] == "mount-local" else None

    def queue(self, name: str | None = None) -> str:
        """The queue that an effect means: by name, or the only one."""
        if name is not None:
            return self.var(name)["id"]
        queues = [v["id"] for v in self.vars if (v.get("role") or {}).get("kind") == QUEUE_ROLE or v["id"] == "sys:pending"]
        if len(queues) != 1:
            raise ModelError("the effect must name its queue")
        return queues[0]

    def reads(self, e: dict) -> set[str]:
        """Variables that an expression reads, guards of transitions that it asks about included."""
        out: set[str] = set()
        for x in exprs_in(e):
            if x["kind"] in ("read", "readPre"):
                out.add(x["var"])
            elif x["kind"] == "freshToken":
                out |= {v["id"] for v in self.vars if has_tokens(v["domain"])}
            elif x["kind"] == "transitionEnabled" and x["transitionId"] in self.by_id:
                out |= self.reads(self.by_id[x["transitionId"]]["guard"])
            elif x["kind"] == "transitionEnabledPrefix":
                for t in self.transitions:
                    if t["id"].startswith(x["prefix"]):
                        out |= self.reads(t["guard"])
        return out

    def effect_reads(self, e: dict) -> set[str]:
        out = set().union(*(self.reads(x) for x in exprs_of_effect(e)), set())
        return out | {self.queue(x.get("queue")) for x in effects_in(e) if x["kind"] in ("enqueue", "dequeue")}

    def effect_writes(self, e: dict) -> set[str]:
        out = {x["var"] for x in effects_in(e) if "var" in x}
        return out | {self.queue(x.get("queue")) for x in effects_in(e) if x["kind"] in ("enqueue", "dequeue")}

    def initial_states(self) -> list[dict[str, Any]]:
        """The product of the variables' initial values."""
        names = [v["id"] for v in self.vars]
        return [dict(zip(names, c, strict=True)) for c in itertools.product(*(dom.initial_values(v["domain"], v["initial"]) for v in self.vars))]

    def to_json(self) -> str:
        return canonical_json({"schemaVersion": 1, "id": self.id, "vars": list(self.vars), "transitions": list(self.transitions), "bounds": {"maxDepth": self.max_depth, "maxPending": self.max_pending, "maxInternalSteps": self.max_internal_steps}, "metadata": self.metadata})


def has_tokens(d: dict) -> bool:
    return d["kind"] == "tokens" or any(has_tokens(x) for x in [*d.get("fields", {}).values(), *d.get("variants", {}).values(), *([d["inner"]] if "inner" in d else [])])


def canonical_json(v: Any) -> str:
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse_model(source: str | dict) -> Model:
    raw = json.loads(source) if isinstance(source, str) else source
    if raw.get("schemaVersion", 1) != 1:
        raise ModelError(f"unsupported schemaVersion {raw.get('schemaVersion')}")
    b = raw.get("bounds", {})
    m = Model(raw["id"], tuple(raw["vars"]), tuple(raw["transitions"]), b.get("maxDepth", 10), b.get("maxPending", 1), b.get("maxInternalSteps", 4), raw.get("metadata") or {})
    if problems := validate(m):
        raise ModelError("; ".join(problems))
    return m


def _expr_problems(m: Model, e: dict, where: str) -> list[str]:
    out = []
    for x in exprs_in(e):
        kind, args = x["kind"], x.get("args", ())
        if kind not in EXPR_KINDS:
            out.append(f"{where}: unknown expression {kind}")
        if kind in ("read", "readPre") and x["var"] not in m.index:
            out.append(f"{where}: unknown variable {x['var']}")
        if kind == "freshToken" and (x["domainOf"] not in m.index or not has_tokens(m.var(x["domainOf"])["domain"])):
            out.append(f"{where}: {x['domainOf']} has no tokens")
        wanted = {"not": 1, "cond": 3} | dict.fromkeys(("lt", "lte", "gt", "gte", "add", "sub", "mod"), 2)
        if kind in wanted and len(args) != wanted[kind]:
            out.append(f"{where}: {kind} takes {wanted[kind]} arguments")
    return out


def validate(m: Model) -> list[str]:
    """What is wrong with a model, in words; an empty list if nothing is."""
    out = [f"duplicate variable {k}" for k, g in itertools.groupby(sorted(v["id"] for v in m.vars)) if len(list(g)) > 1]
    out += [f"duplicate transition {k}" for k, g in itertools.groupby(sorted(t["id"] for t in m.transitions)) if len(list(g)) > 1]
    if m.max_depth < 0 or m.max_pending < 0 or m.max_internal_steps < 1:
        out.append("bounds: maxDepth and maxPending are 0 or more, maxInternalSteps 1 or more")
    for v in m.vars:
        d = v["domain"]
        try:
            dom.shape_of(d)
        except (KeyError, TypeError, ValueError) as e:
            out.append(f"variable {v['id']}: {e}")
            continue
        if d["kind"] == "boundedInt" and d["min"] > d["max"]:
            out.append(f"variable {v['id']}: min is over max")
        for x in dom.initial_values(d, v["initial"]):
            if x != dom.UNMOUNTED and not dom.contains(d, x):
                out.append(f"variable {v['id']}: initial value {x!r} is not in its domain")
        if (guard := m.mount_guard(v)) is not None:
            out += _expr_problems(m, guard, f"variable {v['id']}")
    for t in m.transitions:
        where = f"transition {t['id']}"
        if t["cls"] not in CLASSES:
            out.append(f"{where}: unknown class {t['cls']}")
        out += _expr_problems(m, t["guard"], where)
        for e in effects_in(t["effect"]):
            if e["kind"] not in EFFECT_KINDS:
                out.append(f"{where}: unknown effect {e['kind']}")
            if e["kind"] == "opaque":
                out.append(f"{where}: opaque effects cannot be checked")
            if "var" in e and e["var"] not in m.index:
                out.append(f"{where}: unknown variable {e['var']}")
        for e in exprs_of_effect(t["effect"]):
            if e["kind"] in EXPR_KINDS and e["kind"] == "read" and e["var"] not in m.index:
                out.append(f"{where}: unknown variable {e['var']}")
        for k in t.get("triggeredBy") or ():
            if k not in m.index:
                out.append(f"{where}: triggered by unknown variable {k}")
    return out


def apply_overlay(m: Model, overlay: dict) -> Model:
    """A model with transitions replaced, domains refined, variables ignored (they keep their initial value)."""
    replaced = {t["id"]: t for t in overlay.get("transitions", ())}
    refined, ignored = overlay.get("domains", {}), set(overlay.get("ignoreVars", ()))
    out_vars = tuple({**v, "domain": refined.get(v["id"], v["domain"])} for v in m.vars)
    out_transitions = tuple(replaced.get(t["id"], t) for t in m.transitions) + tuple(t for k, t in replaced.items() if k not in m.by_id)
    if ignored:
        out_transitions = tuple({**t, "effect": _without_writes(t["effect"], ignored)} for t in out_transitions)
    provenance = {**m.metadata.get("domainProvenance", {}), **dict.fromkeys(refined, "overlay-refined")}
    out = Model(m.id, out_vars, out_transitions, m.max_depth, m.max_pending, m.max_internal_steps, {**m.metadata, "domainProvenance": provenance})
    if problems := validate(out):
        raise ModelError("; ".join(problems))
    return out


def _without_writes(e: dict, names: set[str]) -> dict:
    if e.get("var") in names:
        return {"kind": "seq", "effects": []}
    if e["kind"] == "seq":
        return {**e, "effects": [_without_writes(x, names) for x in e["effects"]]}
    if e["kind"] == "if":
        return {**e, "then": _without_writes(e["then"], names), "else": _without_writes(e["else"], names)}
    return e
