"""Model generators: navigation, cached fetches, mutations. They emit plain variables and transitions."""

from __future__ import annotations


def _lit(v):
    return {"kind": "lit", "value": v}


def _read(v, *path):
    return {"kind": "read", "var": v, **({"path": list(path)} if path else {})}


def _eq(a, b):
    return {"kind": "eq", "args": [a, b]}


def _set(v, x):
    return {"kind": "assign", "var": v, "expr": x if isinstance(x, dict) else _lit(x)}


def _seq(*e):
    return {"kind": "seq", "effects": list(e)}


def _if(c, a, b=None):
    return {"kind": "if", "cond": c, "then": a, "else": b or _seq()}


def _rule(id_, cls, label, guard, effect, **more):
    return {"id": id_, "cls": cls, "label": label, "source": [], "guard": guard, "effect": effect, "reads": [], "writes": [], "confidence": "exact", **more}


def _var(id_, domain, initial, **more):
    return {"id": id_, "domain": domain, "origin": "library-template", "scope": {"kind": "global"}, "initial": initial, **more}


def location(routes: list[str], start: str, depth: int = 2, route: str = "sys:route", history: str = "sys:history") -> list[dict]:
    """The current route and a history of bounded length."""
    d = {"kind": "enum", "values": routes}
    return [_var(route, d, start, role={"kind": "location-current"}), _var(history, {"kind": "boundedList", "inner": d, "maxLen": depth}, [], role={"kind": "location-history"})]


def navigate(mode: str, routes: list[str], to: str | None = None, depth: int = 2, route: str = "sys:route", history: str = "sys:history") -> dict:
    """push: the current route joins the history as long as it has room; replace: it does not; back: its last returns."""
    if mode == "replace":
        return _set(route, to)
    if mode == "push":
        grown = _seq()  # a full history keeps what it has
        for n in reversed(range(depth)):
            step = _set(history, {"kind": "updateField", "target": _read(history), "path": [str(n)], "value": {"kind": "readPre", "var": route}})
            grown = _if({"kind": "neq", "args": [_read(history, str(n)), _lit(None)]}, grown, step)
        return _seq(grown, _set(route, to))
    if mode == "back":
        # The history is a short list: try its lengths from the longest down.
        out = _seq()
        for n in range(1, depth + 1):
            have = {"kind": "neq", "args": [_read(history, str(n - 1)), _lit(None)]}
            out = _if(have, _seq(_set(route, _read(history, str(n - 1))), {"kind": "dequeue", "queue": history, "index": n - 1}), out)
        return out
    raise ValueError(f"unknown navigation {mode}")


def cached_fetch(key: str, op: str, data: list[str], focus: bool = True, errors: bool = True, queue: str = "sys:pending") -> tuple[list[dict], list[dict]]:
    """A stale-while-revalidate cache entry: fetch, resolve with any of data, error, refetch on focus, mutate."""
    d, v, e = f"{key}:data", f"{key}:validating", f"{key}:error"
    names = ["none", *data]
    variables = [_var(d, {"kind": "enum", "values": names}, "none", role={"kind": "cache-entry"}), _var(v, {"kind": "bool"}, False, role={"kind": "cache-entry"}), _var(e, {"kind": "bool"}, False, role={"kind": "cache-entry"})]
    idle, mine = {"kind": "not", "args": [_read(v)]}, _eq(_read(queue, "0", "opId"), _lit(op))
    start = _seq(_set(v, True), {"kind": "enqueue", "queue": queue, "op": op, "continuation": f"{key}#resolve", "args": {}})
    rules = [_rule(f"{key}.fetch", "library", {"kind": "env", "key": key}, {"kind": "and", "args": [idle, _eq(_read(d), _lit("none"))]}, start)]
    rules += [_rule(f"{key}.resolve.{x}", "env", {"kind": "resolve", "op": op, "outcome": x}, mine, _seq({"kind": "dequeue", "queue": queue, "index": 0}, _set(d, x), _set(v, False), _set(e, False))) for x in data]
    if errors:
        rules.append(_rule(f"{key}.resolve.error", "env", {"kind": "resolve", "op": op, "outcome": "error"}, mine, _seq({"kind": "dequeue", "queue": queue, "index": 0}, _set(v, False), _set(e, True))))
    if focus:
        rules.append(_rule(f"{key}.focus", "env", {"kind": "focus-revalidate", "key": key}, {"kind": "and", "args": [idle, {"kind": "neq", "args": [_read(d), _lit("none")]}]}, start))
    rules.append(_rule(f"{key}.mutate", "library", {"kind": "env", "key": key}, idle, start))
    return variables, rules


def mutation(key: str, op: str, invalidates: tuple[str, ...] = (), queue: str = "sys:pending") -> tuple[list[dict], list[dict]]:
    """A mutation: idle, pending, success or error; success makes the caches it invalidates stale."""
    s = f"{key}:status"
    mine = _eq(_read(queue, "0", "opId"), _lit(op))
    out = lambda status, *more: _seq({"kind": "dequeue", "queue": queue, "index": 0}, _set(s, status), *more)
    rules = [
        _rule(f"{key}.mutate", "user", {"kind": "submit"}, {"kind": "neq", "args": [_read(s), _lit("pending")]}, _seq(_set(s, "pending"), {"kind": "enqueue", "queue": queue, "op": op, "continuation": f"{key}#resolve", "args": {}})),
        _rule(f"{key}.success", "env", {"kind": "resolve", "op": op, "outcome": "success"}, mine, out("success", *(_set(f"{k}:data", "none") for k in invalidates))),
        _rule(f"{key}.error", "env", {"kind": "resolve", "op": op, "outcome": "error"}, mine, out("error")),
        _rule(f"{key}.reset", "user", {"kind": "click"}, {"kind": "neq", "args": [_read(s), _lit("pending")]}, _set(s, "idle")),
    ]
    return [_var(s, {"kind": "enum", "values": ["idle", "pending", "success", "error"]}, "idle")], rules


def pending_queue(ops: list[str], continuations: list[str], most: int, args: dict | None = None) -> dict:
    item = {"kind": "record", "fields": {"opId": {"kind": "enum", "values": ops}, "continuation": {"kind": "enum", "values": continuations}, "args": {"kind": "record", "fields": args or {}}}}
    return _var("sys:pending", {"kind": "boundedList", "inner": item, "maxLen": most}, [], role={"kind": "pending-queue"})
