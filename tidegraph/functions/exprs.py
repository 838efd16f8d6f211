"""Expressions over states as Columns. Everything stays in built-in functions, so a guard is a filter like any other."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions import domains as dom
from tidegraph.functions.domains import Shape, ddl, merge, shape_of
from tidegraph.model import Model, ModelError


@dataclass(frozen=True)
class Val:
    """A Column, its shape, and whether the variable is unmounted (None: never)."""

    col: Column
    shape: Shape
    away: Column | None = None
    domain: dict | None = None


def true(v: Val) -> Column:
    """Only a boolean that is true counts."""
    if v.shape != ("bool",):
        return F.lit(False)
    c = F.coalesce(v.col, F.lit(False))
    return c if v.away is None else c & ~v.away


def literal(v: Any) -> Val:
    if v is None:
        return Val(F.lit(None), ("null",))
    if isinstance(v, bool):
        return Val(F.lit(v), ("bool",))
    if isinstance(v, int):
        return Val(F.lit(v).cast("bigint"), ("int",))
    if isinstance(v, float):
        return literal(int(v)) if v.is_integer() else Val(F.lit(v), ("num",))
    if isinstance(v, str):
        return Val(F.lit(v), ("str",), F.lit(True) if v == dom.UNMOUNTED else None)
    if isinstance(v, list):
        items = [literal(x) for x in v]
        inner = reduce(merge, (x.shape for x in items), ("null",))
        return Val(F.array(*(fit(x, inner) for x in items)).cast(f"array<{ddl(inner)}>"), ("list", inner))
    fields = {k: literal(v[k]) for k in sorted(v)}
    return Val(F.struct(*(x.col.alias(k) for k, x in fields.items())), ("rec", tuple((k, x.shape) for k, x in fields.items())))


def fit(v: Val, to: Shape) -> Column:
    """v as a column of shape `to`, which must hold its shape."""
    if v.shape == to:
        return v.col
    if v.shape == ("null",):
        return F.lit(None).cast(ddl(to))
    if v.shape[0] == to[0] == "list":
        return F.transform(v.col, lambda x: fit(Val(x, v.shape[1]), to[1]))
    if v.shape[0] == to[0] == "rec":
        have = dict(v.shape[1])
        made = F.struct(*((fit(Val(v.col.getField(k), have[k]), s) if k in have else F.lit(None).cast(ddl(s))).alias(k) for k, s in to[1]))
        return F.when(v.col.isNotNull(), made)
    raise TypeError(f"a value of shape {v.shape} does not fit {to}")


def same(a: Val, b: Val) -> Column:
    """Deep equality; null equals null, values of different types differ, unmounted equals only unmounted."""
    try:
        shape = merge(a.shape, b.shape)
        eq = F.lit(True) if shape == ("null",) else fit(a, shape).eqNullSafe(fit(b, shape))
    except TypeError:
        eq = F.lit(False)
    if a.away is None and b.away is None:
        return eq
    x, y = (F.lit(False) if v.away is None else v.away for v in (a, b))
    return (x & y) | (~x & ~y & eq)


class Scope:
    """Where expressions are evaluated: a model, a state struct, and optionally the state before and the operation."""

    def __init__(self, model: Model, state: Column, pre: Column | None = None, op_args: Val | None = None):
        self.model, self.state, self.pre, self.op_args = model, state, pre, op_args

    def var(self, name: str, state: Column | None = None) -> Val:
        v, s = self.model.var(name), self.state if state is None else state
        i = self.model.index[name]
        away = s.getField(f"u{i}") if self.model.mount_guard(v) is not None else None
        return Val(s.getField(f"v{i}"), shape_of(v["domain"]), away, v["domain"])

    def path(self, v: Val, path) -> Val:
        for step in path or ():
            if v.shape[0] == "rec":
                shape = dict(v.shape[1]).get(step)
                if shape is None:
                    return literal(None)
                fields = (v.domain or {}).get("fields", {})
                v = Val(v.col.getField(step), shape, None, fields.get(step))
            elif v.shape[0] == "list":
                at = int(step) if str(step).isdigit() else 0
                v = Val(F.get(v.col, F.lit(at)), v.shape[1], None, (v.domain or {}).get("inner"))
            else:
                return literal(None)
        return v

    def mounted(self, guard: dict, state: Column | None = None) -> Column:
        return true(Scope(self.model, self.state if state is None else state).eval(guard))

    def enabled(self, t: dict) -> Column:
        """The guard holds and every mount-local variable that the transition reads or writes is mounted."""
        names = set(t.get("reads", ())) | set(t.get("writes", ()))
        guards = [self.model.mount_guard(self.model.var(n)) for n in sorted(names) if n in self.model.index]
        return reduce(lambda a, b: a & b, (self.mounted(g) for g in guards if g is not None), true(self.eval(t["guard"])))

    def eval(self, e: dict) -> Val:
        kind = e["kind"]
        if kind == "lit":
            return literal(e["value"])
        if kind == "read":
            return self.path(self.var(e["var"]), e.get("path"))
        if kind == "readPre":
            return literal(None) if self.pre is None else self.path(self.var(e["var"], self.pre), e.get("path"))
        if kind == "readOpArg":
            return literal(None) if self.op_args is None else self.path(self.op_args, [e["key"]])
        if kind in ("transitionEnabled", "transitionEnabledPrefix"):
            ids = [e["transitionId"]] if kind == "transitionEnabled" else [i for i in self.model.by_id if i.startswith(e["prefix"])]
            found = [self.enabled(self.model.by_id[i]) for i in sorted(ids) if i in self.model.by_id]
            return Val(reduce(lambda a, b: a | b, found, F.lit(False)), ("bool",))
        if kind == "freshToken":
            names, used = F.array(*map(F.lit, dom.token_names(token_domain(self.model.var(e["domainOf"])["domain"])))), tokens_in(self)
            return Val(F.get(F.array_except(names, used), F.lit(0)), ("str",))
        if kind == "updateField":
            return self.update(self.eval(e["target"]), list(e["path"]), self.eval(e["value"]))
        if kind in ("tagIs", "lenCat"):
            v = self.eval(e["arg"])
            if kind == "tagIs":
                tag = (v.domain or {}).get("tag")
                return Val(F.lit(False) if tag is None else v.col.getField(tag).eqNullSafe(F.lit(e["tag"])), ("bool",))
            if v.shape[0] != "list":
                return literal("0")
            n = F.coalesce(F.size(v.col), F.lit(0))
            return Val(F.when(n <= 0, "0").when(n == 1, "1").otherwise("many"), ("str",))
        if kind == "cond":
            c, a, b = (self.eval(x) for x in e["args"])
            shape = merge(a.shape, b.shape)
            away = None if a.away is None and b.away is None else F.when(true(c), F.lit(False) if a.away is None else a.away).otherwise(F.lit(False) if b.away is None else b.away)
            return Val(F.when(true(c), fit(a, shape)).otherwise(fit(b, shape)), shape, away)
        args = [self.eval(x) for x in e["args"]]
        if kind in ("eq", "neq"):
            c = same(args[0], args[1])
            return Val(c if kind == "eq" else ~c, ("bool",))
        if kind in ("and", "or"):
            both = (lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b)
            return Val(reduce(both, map(true, args), F.lit(kind == "and")), ("bool",))
        if kind == "not":
            return Val(~true(args[0]), ("bool",))
        a, b = args
        whole = a.shape == b.shape == ("int",)
        there = reduce(lambda x, y: x & y, (~v.away for v in args if v.away is not None), F.lit(True))
        if kind in ("lt", "lte", "gt", "gte"):
            if not whole:
                return literal(False)
            c = {"lt": a.col < b.col, "lte": a.col <= b.col, "gt": a.col > b.col, "gte": a.col >= b.col}[kind]
            return Val(F.coalesce(c, F.lit(False)) & there, ("bool",))
        if kind in ("add", "sub", "mod"):
            if not whole:
                return Val(F.lit(None).cast("bigint"), ("int",))
            c = {"add": lambda: F.try_add(a.col, b.col), "sub": lambda: F.try_subtract(a.col, b.col), "mod": lambda: F.when(b.col != 0, F.pmod(a.col, F.abs(F.when(b.col != 0, b.col))))}[kind]()
            return Val(F.when(there, c), ("int",))
        raise ModelError(f"unknown expression {kind}")

    def update(self, v: Val, path: list[str], new: Val) -> Val:
        if not path:
            return new
        step, rest = path[0], path[1:]
        if v.shape[0] == "rec":
            have = dict(v.shape[1])
            inner = self.update(Val(v.col.getField(step), have[step]) if step in have else literal(None), rest, new)
            if step in have:
                shape = merge(have[step], inner.shape)
                if shape == have[step]:
                    return Val(v.col.withField(step, fit(inner, shape)), v.shape, None, v.domain)
                inner = Val(fit(inner, shape), shape)
            fields = {**{k: Val(v.col.getField(k), s) for k, s in v.shape[1]}, step: inner}
            return Val(F.struct(*(fields[k].col.alias(k) for k in sorted(fields))), ("rec", tuple((k, fields[k].shape) for k in sorted(fields))))
        if v.shape[0] == "list":
            at = int(step) if str(step).isdigit() else 0
            inner = self.update(Val(F.get(v.col, F.lit(at)), v.shape[1]), rest, new)
            shape = merge(v.shape[1], inner.shape)
            longer = F.concat(F.transform(v.col, lambda x: fit(Val(x, v.shape[1]), shape)), F.transform(F.sequence(F.size(v.col), F.greatest(F.size(v.col), F.lit(at))), lambda _: F.lit(None).cast(ddl(shape))))
            long = F.slice(longer, F.lit(1), F.greatest(F.size(v.col), F.lit(at + 1)))
            return Val(F.transform(long, lambda x, i: F.when(i == at, fit(inner, shape)).otherwise(x)), ("list", shape))
        inner = self.update(literal(None), rest, new)
        return Val(F.struct(inner.col.alias(step)), ("rec", ((step, inner.shape),)))


def token_domain(d: dict) -> dict:
    """The tokens domain inside a domain."""
    if d["kind"] == "tokens":
        return d
    for x in [*d.get("fields", {}).values(), *d.get("variants", {}).values(), *([d["inner"]] if "inner" in d else [])]:
        try:
            return token_domain(x)
        except ModelError:
            pass
    raise ModelError("no tokens here")


def token_sites(d: dict, col: Column) -> Column | None:
    """Array of the tokens in a value, in the order of the key."""
    kind = d["kind"]
    if kind == "tokens":
        return F.array(col)
    if kind == "option":
        return token_sites(d["inner"], col)
    if kind == "boundedList":
        if token_sites(d["inner"], col) is None:
            return None
        return F.coalesce(F.flatten(F.transform(col, lambda x: token_sites(d["inner"], x))), F.array().cast("array<string>"))
    if kind == "record":
        found = [token_sites(d["fields"][k], col.getField(k)) for k in sorted(d["fields"])]
    elif kind == "tagged":
        found = []
        for v in sorted(d["variants"]):
            for k, x in sorted(dom.variant_fields(d, v).items()):
                s = token_sites(x, col.getField(k))
                found.append(None if s is None else F.when(col.getField(d["tag"]).eqNullSafe(F.lit(v)), s).otherwise(F.array().cast("array<string>")))
    else:
        return None
    found = [x for x in found if x is not None]
    return F.concat(*found) if found else None


def tokens_in(scope: Scope) -> Column:
    sites = []
    for v in scope.model.vars:
        x = scope.var(v["id"])
        s = token_sites(v["domain"], x.col)
        if s is not None:
            sites.append(s if x.away is None else F.when(~x.away, s).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.concat(*sites), lambda t: t.isNotNull())) if sites else F.array().cast("array<string>")
