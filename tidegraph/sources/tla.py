"""TLA+ text of a model."""

from __future__ import annotations

import re
from typing import Any

from tidegraph.functions import domains as dom
from tidegraph.model import Model, exprs_in


def name(s: str) -> str:
    return re.sub(r"\W", "_", s) if re.match(r"[A-Za-z_]", s) else "v_" + re.sub(r"\W", "_", s)


def value(v: Any) -> str:
    if v is None:
        return '"null"'
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if isinstance(v, list):
        return "<<" + ", ".join(map(value, v)) + ">>"
    return "[" + ", ".join(f"{name(k)} |-> {value(v[k])}" for k in sorted(v)) + "]"


SIGNS = {"eq": "=", "neq": "#", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "add": "+", "sub": "-", "mod": "%"}


def expr(e: dict) -> str:
    kind = e["kind"]
    if kind == "lit":
        return value(e["value"])
    if kind == "read":
        return name(e["var"]) + "".join(f"[{int(p) + 1}]" if str(p).isdigit() else f".{name(p)}" for p in e.get("path") or ())
    if kind in ("and", "or"):
        return "(" + (" /\\ " if kind == "and" else " \\/ ").join(map(expr, e["args"])) + ")" if e["args"] else value(kind == "and")
    if kind == "not":
        return f"~({expr(e['args'][0])})"
    if kind == "cond":
        return "(IF {} THEN {} ELSE {})".format(*map(expr, e["args"]))
    if kind in SIGNS:
        return f"({expr(e['args'][0])} {SIGNS[kind]} {expr(e['args'][1])})"
    raise ValueError(f"{kind} has no TLA+ form here")


def branches(model: Model, e: dict) -> list[tuple[list[str], dict[str, str]]]:
    """Alternatives of an effect: conditions, and new values of the variables it writes."""
    out: list[tuple[list[str], dict[str, str]]] = [([], {})]

    def run(e: dict, conds: list[str], new: dict[str, str]):
        kind = e["kind"]
        # Within an action later statements see earlier writes.
        put = lambda x: _substituted(expr(x), new)
        if kind == "assign":
            yield conds, {**new, name(e["var"]): put(e["expr"])}
        elif kind == "havoc":
            for v in dom.enumerate_domain(model.var(e["var"])["domain"]):
                yield conds, {**new, name(e["var"]): value(v)}
        elif kind == "choose":
            for x in e["among"]:
                yield conds, {**new, name(e["var"]): put(x)}
        elif kind == "if":
            c = put(e["cond"])
            yield from run(e["then"], [*conds, c], new)
            yield from run(e["else"], [*conds, f"~({c})"], new)
        elif kind == "seq":
            at = [(conds, new)]
            for x in e["effects"]:
                at = [y for c, n in at for y in run(x, c, n)]
            yield from at
        elif kind == "enqueue":
            q = name(model.queue(e.get("queue")))
            have = new.get(q, q)
            args = ", ".join(f"{name(k)} |-> {put(v)}" for k, v in sorted(e["args"].items()))
            item = f"[opId |-> {value(e['op'])}, continuation |-> {value(e['continuation'])}, args |-> [{args}]]"
            yield [*conds, f"Len({have}) < {model.max_pending}"], {**new, q: f"Append({have}, {item})"}
        else:
            q = name(model.queue(e.get("queue")))
            have = new.get(q, q)
            yield conds, {**new, q: f"(IF {e['index']} < Len({have}) THEN SubSeq({have}, 1, {e['index']}) \\o SubSeq({have}, {e['index'] + 2}, Len({have})) ELSE {have})"}

    return list(run(e, *out[0]))


def _substituted(text: str, new: dict[str, str]) -> str:
    return re.sub(r"(?<![\w.\"])[A-Za-z_]\w*(?![\w\"])", lambda m: new.get(m[0], m[0]), text)


def module(model: Model) -> str:
    """MODULE text with Init, an action for each transition, Next and Spec."""
    names = [name(v["id"]) for v in model.vars]
    out = [f"---- MODULE {name(model.id)} ----", "EXTENDS Integers, Sequences", "VARIABLES " + ", ".join(names), f"vars == <<{', '.join(names)}>>", "", "Init =="]
    for v in model.vars:
        initials = dom.initial_values(v["domain"], v["initial"])
        out.append(f"  /\\ {name(v['id'])} \\in {{{', '.join(map(value, initials))}}}")
    for t in model.sorted_transitions:
        out += ["", f"{name(t['id'])} ==", f"  /\\ {expr(t['guard'])}"]
        ways = []
        for conds, new in branches(model, t["effect"]):
            same = [n for n in names if n not in new]
            ways.append(" /\\ ".join([*conds, *(f"{k}' = {v}" for k, v in sorted(new.items())), *([f"UNCHANGED <<{', '.join(same)}>>"] if same else [])]))
        out.append("  /\\ " + ("\n     ".join(f"\\/ {w}" for w in ways) if ways else "FALSE"))
    out += ["", "Next == " + (" \\/ ".join(name(t["id"]) for t in model.sorted_transitions) or "FALSE"), "Spec == Init /\\ [][Next]_vars", "===="]
    return "\n".join(out) + "\n"


def assumptions(model: Model) -> list[str]:
    """What the text leaves out."""
    out = [f"{v['id']} is taken as mounted" for v in model.vars if model.mount_guard(v) is not None]
    out += [f"{t['id']} asks for what has no TLA+ form" for t in model.transitions if any(x["kind"] in ("freshToken", "readOpArg", "readPre", "updateField", "tagIs", "lenCat") for x in exprs_in(t["guard"]))]
    return out
