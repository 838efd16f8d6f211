"""Effects as row-to-many projections: each is an array of successor states, empty where it is blocked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions import domains as dom
from tidegraph.functions.domains import ddl, shape_of
from tidegraph.functions.exprs import Scope, Val, fit, literal, true
from tidegraph.model import Model, ModelError


def state_ddl(model: Model) -> str:
    fields = []
    for i, v in enumerate(model.vars):
        fields.append(f"v{i}:{ddl(shape_of(v['domain']))}")
        if model.mount_guard(v) is not None:
            fields.append(f"u{i}:boolean")
    return "struct<" + ",".join(fields) + ">"


def state_row(model: Model, values: dict) -> Column:
    """A literal state struct."""
    fields = []
    for i, v in enumerate(model.vars):
        away = values.get(v["id"]) == dom.UNMOUNTED
        shape = shape_of(v["domain"])
        fields.append(fit(literal(None if away else values.get(v["id"])), shape).alias(f"v{i}"))
        if model.mount_guard(v) is not None:
            fields.append(F.lit(away).alias(f"u{i}"))
    return F.struct(*fields).cast(state_ddl(model))


def written(model: Model, state: Column, name: str, value: Val) -> Column:
    """The state with one variable set."""
    i, v = model.index[name], model.var(name)
    out = state.withField(f"v{i}", fit(Val(F.lit(None), ("null",)) if value.shape == ("str",) and shape_of(v["domain"]) != ("str",) and value.away is not None else value, shape_of(v["domain"])))
    if model.mount_guard(v) is not None:
        out = out.withField(f"u{i}", F.lit(False) if value.away is None else value.away)
    return out


def numeric(d: dict, raw: Column) -> tuple[Column, Column]:
    """The stored value and whether there is one, under the domain's overflow policy."""
    policy = d.get("overflow") or "forbid"
    if d["kind"] == "boundedInt":
        low, high, inside = d["min"], d["max"], raw.between(d["min"], d["max"])
        wrapped, clamped = F.lit(low) + F.pmod(raw, F.lit(high - low + 1)), F.when(raw < low, low).otherwise(high)
    else:
        values = d["values"]
        if not values:
            return raw, F.lit(False)
        inside = raw.isin(*values)
        wrapped = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in values)), (F.pmod(raw, F.lit(len(values))) + 1).cast("int"))
        clamped = F.when(raw <= values[0], values[0]).otherwise(values[-1])
    if policy == "forbid":
        return raw, F.coalesce(inside, F.lit(False))
    return F.when(inside, raw).otherwise((wrapped if policy == "wrap" else clamped).cast("bigint")), raw.isNotNull()


def _fits_list(d: dict, c: Column) -> Column:
    ok = c.isNotNull() & (F.size(c) <= d["maxLen"])
    inner = d["inner"]
    if inner["kind"] in ("enum", "intSet"):
        ok = ok & F.forall(c, lambda x: F.coalesce(x.isin(*inner["values"]), F.lit(False)))
    elif inner["kind"] == "boundedInt":
        ok = ok & F.forall(c, lambda x: F.coalesce(x.between(inner["min"], inner["max"]), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


class Effects:
    """Compiles the effects of a model. pre is the state before the macro-step."""

    def __init__(self, model: Model):
        self.model = model
        self.none = F.array().cast(f"array<{state_ddl(model)}>")

    def apply(self, e: dict, state: Column, pre: Column, op_args: Val | None = None) -> Column:
        m, scope = self.model, Scope(self.model, state, pre, op_args)
        one = lambda s: F.array(s)
        kind = e["kind"]
        if kind == "assign":
            d, v = m.var(e["var"])["domain"], scope.eval(e["expr"])
            blocked = [v.col.isNull()] if any(x["kind"] == "freshToken" for x in _exprs(e["expr"])) else []
            if d["kind"] in ("boundedInt", "intSet"):
                if v.shape != ("int",):
                    return self.none
                value, ok = numeric(d, v.col)
                v = Val(value, ("int",), v.away)
                blocked.append(~ok)
            elif d["kind"] == "boundedList":
                if v.shape[0] != "list":
                    return self.none
                blocked.append(~_fits_list(d, v.col))
            out = one(written(m, state, e["var"], v))
            return reduce(lambda a, b: F.when(F.coalesce(b, F.lit(True)), self.none).otherwise(a), blocked, out)
        if kind == "havoc":
            values = dom.enumerate_domain(m.var(e["var"])["domain"])
            return F.array(*(written(m, state, e["var"], literal(x)) for x in values)) if values else self.none
        if kind == "choose":
            return F.array(*(written(m, state, e["var"], scope.eval(x)) for x in e["among"])) if e["among"] else self.none
        if kind == "if":
            return F.when(true(scope.eval(e["cond"])), self.apply(e["then"], state, pre, op_args)).otherwise(self.apply(e["else"], state, pre, op_args))
        if kind == "seq":
            states, args = one(state), op_args
            for x in e["effects"]:
                if x["kind"] == "dequeue":
                    # The first branch alone decides whose arguments the rest of the sequence sees.
                    queue = Scope(m, F.get(states, F.lit(0))).var(m.queue(x.get("queue")))
                    args = self._op_args(queue, x["index"], args)
                states = F.flatten(F.transform(states, lambda s: self.apply(x, s, pre, args)))
            return states
        if kind in ("enqueue", "dequeue"):
            name = m.queue(e.get("queue"))
            q = scope.var(name)
            have = F.coalesce(q.col, F.array().cast(ddl(q.shape)))
            if kind == "dequeue":
                rest = F.filter(have, lambda _, i: i != e["index"])
                return one(written(m, state, name, Val(rest, q.shape)))
            args = {k: scope.eval(x) for k, x in sorted(e.get("args", {}).items())}
            op = Val(F.struct(F.struct(*(v.col.alias(k) for k, v in args.items())).alias("args") if args else F.lit(None).alias("args"), F.lit(e["continuation"]).alias("continuation"), F.lit(e["op"]).alias("opId")), ("rec", (("args", ("rec", tuple((k, v.shape) for k, v in args.items())) if args else ("null",)), ("continuation", ("str",)), ("opId", ("str",)))))
            item = fit(op, q.shape[1])
            return F.when(F.size(have) >= m.max_pending, self.none).otherwise(one(written(m, state, name, Val(F.array_append(have, item), q.shape))))
        raise ModelError(f"effect {kind} cannot be checked")

    def _op_args(self, queue: Val, index: int, before: Val | None) -> Val | None:
        fields = dict(queue.shape[1][1]) if queue.shape[1][0] == "rec" else {}
        shape = fields.get("args")
        if shape is None or shape == ("null",):
            return before
        found = F.get(queue.col, F.lit(index)).getField("args")
        return Val(found if before is None or before.shape != shape else F.coalesce(found, before.col), shape)

    def reset(self, states: Column, pre: Column | None, preserve: bool = False) -> Column:
        """Mount-local variables after a step: away where their guard is false, initial where it has become true."""
        m = self.model
        for i, v in enumerate(m.vars):
            guard = m.mount_guard(v)
            if guard is None:
                continue
            was = F.lit(False) if pre is None else Scope(m, pre).mounted(guard)
            initials = dom.initial_values(v["domain"], v["initial"])

            def step(s):  # called at once, so the loop's variables are this round's
                here = Scope(m, s).mounted(guard)
                gone = F.array(s.withField(f"v{i}", F.lit(None).cast(ddl(shape_of(v["domain"])))).withField(f"u{i}", F.lit(True)))
                fresh = F.array(*(written(m, s, v["id"], literal(x)) for x in initials))
                return F.when(~here, gone).when(F.lit(preserve) | was, F.array(s)).otherwise(fresh)

            states = F.flatten(F.transform(states, step))
        return states

    def changed(self, before: Column, after: Column) -> Column:
        """Numbers of the variables that differ."""
        from tidegraph.functions.exprs import same

        a, b = Scope(self.model, before), Scope(self.model, after)
        return F.filter(F.array(*(F.when(~same(a.var(v["id"]), b.var(v["id"])), i) for i, v in enumerate(self.model.vars))), lambda x: x.isNotNull())


def _exprs(e: dict):
    from tidegraph.model import exprs_in

    return exprs_in(e)
