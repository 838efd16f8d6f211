"""Values checked against domains: one Column that names every (path, reason) of a row.

A domain is compiled once; values are variants, so typed columns and JSON text are checked by the same expression, inside
the JVM and without a shuffle. A value that stands for an unmounted variable is valid anywhere. Paths are written $.a.b[3].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions import domains as dom

PROBLEMS = "array<struct<path:string,reason:string>>"


def variant(value: Column, data_type: str) -> Column:
    """A typed column as a variant; structs, arrays and maps become objects and lists. Nulls become JSON nulls."""
    nested = data_type.startswith(("struct", "array", "map"))
    return F.coalesce(F.to_variant_object(value) if nested else value.cast("variant"), F.parse_json(F.lit("null")))


def json_variant(text: Column) -> Column:
    """JSON text as a variant; null where it is not JSON, or null itself."""
    return F.try_parse_json(text)


def _kind(v: Column) -> Column:
    """The JSON type: VOID, BOOLEAN, BIGINT, DECIMAL, DOUBLE, STRING, OBJECT or ARRAY; null for what isn't there."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _one(path: Column, reason: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason")))


def _none() -> Column:
    return F.array().cast(PROBLEMS)


def _first(*checks: tuple[Column, str], path: Column, rest: Column | None = None) -> Column:
    """The first check that is true makes the only problem; none, the rest."""
    out = _none() if rest is None else rest
    for bad, reason in reversed(checks):
        out = F.when(bad, _one(path, reason)).otherwise(out)
    return out


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _among(v: Column, values: list[str]) -> Column:
    return F.coalesce(_text(v).isin(*values), F.lit(False)) if values else F.lit(False)


def violations(d: dom.Domain, v: Column, path: Column | None = None) -> Column:
    """An array of (path, reason) for a variant: empty if it is a value of the domain."""
    path = F.lit("$") if path is None else path
    return F.when(F.coalesce((_kind(v) == "STRING") & (_text(v) == dom.UNMOUNTED), F.lit(False)), _none()).otherwise(_checked(d, v, path))


def _checked(d: dom.Domain, v: Column, path: Column) -> Column:
    kind, found = d["kind"], _kind(v)
    gone = (v.isNull(), "missing")
    if kind == "option":
        return F.when(found == "VOID", _none()).otherwise(_checked(d["inner"], v, path))
    if kind == "bool":
        return _first(gone, (found != "BOOLEAN", "not a boolean"), path=path)
    if kind in ("boundedInt", "intSet"):
        n = F.try_variant_get(v, "$", "decimal(38,0)")
        real = F.try_variant_get(v, "$", "double")
        whole = (found == "BIGINT") | (found.isin("DECIMAL", "DOUBLE") & F.coalesce(real == F.rint(real), F.lit(False)))
        checks = [gone, (~whole, "not an integer")]
        if kind == "boundedInt":
            checks += [(n < d["min"], f"below {d['min']}"), (n > d["max"], f"above {d['max']}")]
        else:
            checks.append((~n.isin(*d["values"]) if d["values"] else F.lit(True), "not one of the integers"))
        return _first(*checks, path=path)
    if kind in ("enum", "tokens", "lengthCat"):
        values = {"enum": lambda: d["values"], "tokens": lambda: dom.token_names(d), "lengthCat": lambda: ["0", "1", "many"]}[kind]()
        return _first(gone, (found != "STRING", "not a string"), (~_among(v, values), "not one of the values"), path=path)
    if kind == "boundedList":
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.flatten(F.transform(items, lambda x, i: violations(d["inner"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return _first(gone, (found != "ARRAY", "not a list"), (F.size(items) > d["maxLen"], f"longer than {d['maxLen']}"), path=path, rest=each)
    if kind == "record":
        return _first(gone, (found != "OBJECT", "not an object"), path=path, rest=_fields(d["fields"], v, path))
    if kind == "tagged":
        tag = F.try_variant_get(v, f"$['{d['tag']}']", "variant")
        at = F.concat(path, F.lit(f".{d['tag']}"))
        inside = _first((tag.isNull(), "missing"), (~_among(tag, sorted(d["variants"])), "not one of the variants"), path=at)
        for name in sorted(d["variants"]):
            inside = F.when(_text(tag) == name, _fields(dom.variant_fields(d, name), v, path)).otherwise(inside)
        return _first(gone, (found != "OBJECT", "not an object"), path=path, rest=inside)
    raise ValueError(f"unknown domain {kind}")


def _fields(fields: dict[str, dom.Domain], v: Column, path: Column) -> Column:
    each = [violations(x, F.try_variant_get(v, f"$['{k}']", "variant"), F.concat(path, F.lit(f".{k}"))) for k, x in sorted(fields.items())]
    return F.concat(*each) if each else _none()
