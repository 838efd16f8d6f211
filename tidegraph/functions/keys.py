"""Canonical keys of states: type-tagged bytes, variables in declaration order, tokens renamed by first occurrence.

The layout decides the order of states, and that order which of several counterexamples is reported: strings carry their
length first, numbers are little-endian. A state's key is a BINARY column, good for DISTINCT, joins and min_by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions import domains as dom
from tidegraph.functions.exprs import Scope, tokens_in
from tidegraph.model import Model

# The tags of the layout.
NULL, FALSE, TRUE, INT, STRING, UNMOUNTED, RECORD, TAGGED, LIST = (f"{i:02X}" for i in range(9))


def _little(n: Column, size: int) -> Column:
    """Hex digits of a number, its bytes reversed."""
    h = F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))))


def _string(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.concat(F.lit(STRING), _little(F.octet_length(s), 4), F.hex(s))


def _encode(d: dict, c: Column, names: Column) -> Column:
    kind = d["kind"]
    if kind == "bool":
        return F.when(c.isNull(), NULL).when(c, TRUE).otherwise(FALSE)
    if kind in ("enum", "lengthCat"):
        return _string(c)
    if kind in ("boundedInt", "intSet"):
        return F.concat(F.lit(INT), _little(F.coalesce(c, F.lit(0)), 8))
    if kind == "tokens":
        return F.when(c.isNull(), NULL).otherwise(_string(F.concat(F.lit("tok"), F.array_position(names, c))))
    if kind == "option":
        return F.when(c.isNull(), NULL).otherwise(_encode(d["inner"], c, names))
    if kind == "record":
        keys = sorted(d["fields"])
        return F.concat(F.lit(RECORD + len(keys).to_bytes(4, "little").hex().upper()), *(_encode(d["fields"][k], c.getField(k), names) for k in keys))
    if kind == "tagged":
        tag, out = c.getField(d["tag"]), F.concat(_string(F.lit(None).cast("string")), F.lit("00000000"))
        for v in sorted(d["variants"]):
            fields = dom.variant_fields(d, v)
            keys = sorted([*fields, d["tag"]])
            body = [_string(F.lit(v)) if k == d["tag"] else _encode(fields[k], c.getField(k), names) for k in keys]
            out = F.when(tag.eqNullSafe(F.lit(v)), F.concat(_string(F.lit(v)), F.lit(len(keys).to_bytes(4, "little").hex().upper()), *body)).otherwise(out)
        return F.concat(F.lit(TAGGED), out)
    items = F.coalesce(F.array_join(F.transform(c, lambda x: _encode(d["inner"], x, names)), ""), F.lit(""))
    return F.concat(F.lit(LIST), _little(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)), 4), items)


def state_key(model: Model, state: Column) -> Column:
    scope = Scope(model, state)
    names, parts = tokens_in(scope), []
    for v in model.vars:
        x = scope.var(v["id"])
        code = _encode(v["domain"], x.col, names)
        parts.append(code if x.away is None else F.when(x.away, UNMOUNTED).otherwise(code))
    return F.unhex(F.concat(*parts)) if parts else F.lit(b"")


def canonical_state(model: Model, state: Column) -> Column:
    """A short name of a state, for reports: a hash of its key."""
    return F.lower(F.hex(F.xxhash64(state_key(model, state))))
