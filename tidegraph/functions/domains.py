"""Finite domains of state variables, and their Spark types.

A value's shape is a tuple: ("bool",), ("int",), ("str",), ("null",), ("list", shape), ("rec", ((name, shape), ...)).
Records sort their fields; a tagged domain is a record of its tag and the fields of all variants, null where absent.
"""

from __future__ import annotations

import itertools
import json
import math
from typing import Any

UNMOUNTED = "__unmounted__"  # fixed value: what a variable that is not mounted reads as
LARGEST = 2**53 - 1
Domain = dict[str, Any]
Shape = tuple


def token_names(d: Domain) -> list[str]:
    return list(d.get("names") or [f"tok{i + 1}" for i in range(d["count"])])


def variant_fields(d: Domain, variant: str) -> dict[str, Domain]:
    v = d["variants"][variant]
    return {k: x for k, x in v["fields"].items() if k != d["tag"]} if v["kind"] == "record" else {}


def shape_of(d: Domain) -> Shape:
    kind = d["kind"]
    if kind == "bool":
        return ("bool",)
    if kind in ("boundedInt", "intSet"):
        return ("int",)
    if kind in ("enum", "tokens", "lengthCat"):
        return ("str",)
    if kind == "option":
        return shape_of(d["inner"])
    if kind == "boundedList":
        return ("list", shape_of(d["inner"]))
    if kind == "record":
        fields = sorted((k, shape_of(v)) for k, v in d["fields"].items())
        return ("rec", tuple(fields or [("_", ("null",))]))  # files hold no struct without fields
    if kind == "tagged":
        fields = {d["tag"]: ("str",)}
        for v in sorted(d["variants"]):
            for k, x in variant_fields(d, v).items():
                fields[k] = merge(fields.get(k, ("null",)), shape_of(x))
        return ("rec", tuple(sorted(fields.items())))
    raise ValueError(f"unknown domain {kind}")


def merge(a: Shape, b: Shape) -> Shape:
    """The shape that holds values of both."""
    if a == b or b == ("null",):
        return a
    if a == ("null",):
        return b
    if a[0] == b[0] == "list":
        return ("list", merge(a[1], b[1]))
    if a[0] == b[0] == "rec":
        x, y = dict(a[1]), dict(b[1])
        return ("rec", tuple(sorted((k, merge(x.get(k, ("null",)), y.get(k, ("null",)))) for k in x | y)))
    raise TypeError(f"no shape holds both {a} and {b}")


def ddl(s: Shape) -> str:
    if s[0] == "list":
        return f"array<{ddl(s[1])}>"
    if s[0] == "rec":
        return "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in s[1]) + ">"
    return {"bool": "boolean", "int": "bigint", "str": "string", "null": "string", "num": "double"}[s[0]]


def cardinality(d: Domain) -> int:
    kind = d["kind"]
    if kind == "bool":
        n = 2
    elif kind in ("enum", "intSet"):
        n = len(d["values"])
    elif kind == "boundedInt":
        n = d["max"] - d["min"] + 1
    elif kind == "option":
        n = 1 + cardinality(d["inner"])
    elif kind == "record":
        n = math.prod(map(cardinality, d["fields"].values()))
    elif kind == "tagged":
        n = sum(map(cardinality, d["variants"].values()))
    elif kind == "tokens":
        n = len(token_names(d))
    elif kind == "lengthCat":
        n = 3
    else:
        n, inner, power = 0, cardinality(d["inner"]), 1
        for _ in range(d["maxLen"] + 1):
            n += power
            power = min(power * inner, LARGEST)
    return min(n, LARGEST)


def enumerate_domain(d: Domain) -> list[Any]:
    """All values, as JSON values, in the order that havoc tries them."""
    kind = d["kind"]
    if kind == "bool":
        return [False, True]
    if kind in ("enum", "intSet"):
        return list(d["values"])
    if kind == "boundedInt":
        return list(range(d["min"], d["max"] + 1))
    if kind == "option":
        return [None, *enumerate_domain(d["inner"])]
    if kind == "tokens":
        return token_names(d)
    if kind == "lengthCat":
        return ["0", "1", "many"]
    if kind == "record":
        names = sorted(d["fields"])
        return [dict(zip(names, v, strict=True)) for v in itertools.product(*(enumerate_domain(d["fields"][k]) for k in names))]
    if kind == "tagged":
        return [{**(v if isinstance(v, dict) else {}), d["tag"]: k} for k in sorted(d["variants"]) for v in enumerate_domain(d["variants"][k])]
    inner = enumerate_domain(d["inner"])
    return [list(v) for n in range(d["maxLen"] + 1) for v in itertools.product(inner, repeat=n)]


def contains(d: Domain, v: Any) -> bool:
    """Whether v is a value of the domain."""
    kind = d["kind"]
    if kind == "option":
        return v is None or contains(d["inner"], v)
    if kind == "bool":
        return isinstance(v, bool)
    if kind == "boundedInt":
        return isinstance(v, int) and not isinstance(v, bool) and d["min"] <= v <= d["max"]
    if kind == "record":
        return isinstance(v, dict) and set(v) <= set(d["fields"]) and all(contains(x, v.get(k)) for k, x in d["fields"].items())
    if kind == "tagged":
        return isinstance(v, dict) and v.get(d["tag"]) in d["variants"] and all(contains(x, v.get(k)) for k, x in variant_fields(d, v[d["tag"]]).items())
    if kind == "boundedList":
        return isinstance(v, list) and len(v) <= d["maxLen"] and all(contains(d["inner"], x) for x in v)
    return not isinstance(v, bool) and v in enumerate_domain(d)


def initial_values(d: Domain, initial: Any) -> list[Any]:
    """A list names several initial values, except for a list domain, where it is one."""
    return list(initial) if isinstance(initial, list) and d["kind"] != "boundedList" else [initial]


def fingerprint(d: Domain) -> str:
    return json.dumps(d, sort_keys=True, separators=(",", ":"))


def bits(d: Domain) -> float:
    n = cardinality(d)
    return round(math.log2(n) + 1e-12, 2) if n >= 1 else 0.0


def from_spark(t) -> Domain | None:
    """The domain of a Spark column type, where it is finite; strings stand for one opaque token."""
    from pyspark.sql import types as T

    if isinstance(t, T.BooleanType):
        return {"kind": "bool"}
    if isinstance(t, T.ByteType):
        return {"kind": "boundedInt", "min": -128, "max": 127}
    if isinstance(t, T.StringType):
        return {"kind": "tokens", "count": 1}
    if isinstance(t, T.ArrayType):
        return {"kind": "lengthCat"}
    if isinstance(t, T.StructType):
        fields = {f.name: from_spark(f.dataType) for f in t}
        return None if None in fields.values() else {"kind": "record", "fields": {k: {"kind": "option", "inner": v} if t[k].nullable else v for k, v in fields.items()}}
    return None


def from_json_schema(s: dict) -> Domain:
    """The domain of a JSON schema: constants, enumerations, integer ranges, objects, bounded arrays, discriminated unions."""
    if "const" in s:
        return from_json_schema({"enum": [s["const"]]})
    if "enum" in s:
        values = [v for v in s["enum"] if v is not None]
        ints = values and all(isinstance(v, int) and not isinstance(v, bool) for v in values)
        d: Domain = {"kind": "intSet", "values": sorted(values)} if ints else {"kind": "enum", "values": [str(v) for v in values]}
        return {"kind": "option", "inner": d} if None in s["enum"] else d
    if alternatives := s.get("oneOf") or s.get("anyOf"):
        solid = [a for a in alternatives if a.get("type") != "null"]
        if len(solid) == 1:
            inner = from_json_schema(solid[0])
        else:
            shared = set.intersection(*(({k for k, v in a.get("properties", {}).items() if "const" in v}) for a in solid))
            if not shared:
                raise ValueError("a union needs a property whose constant tells its members apart")
            tag = min(shared)
            inner = {"kind": "tagged", "tag": tag, "variants": {a["properties"][tag]["const"]: from_json_schema({**a, "properties": {k: v for k, v in a["properties"].items() if k != tag}}) for a in solid}}
        return {"kind": "option", "inner": inner} if len(solid) < len(alternatives) else inner
    kind = s.get("type")
    if kind == "boolean":
        return {"kind": "bool"}
    if kind == "integer" and "minimum" in s and "maximum" in s:
        return {"kind": "boundedInt", "min": s["minimum"], "max": s["maximum"]}
    if kind == "object":
        need = set(s.get("required", ()))
        fields = {k: from_json_schema(v) for k, v in s.get("properties", {}).items()}
        return {"kind": "record", "fields": {k: v if k in need else {"kind": "option", "inner": v} for k, v in fields.items()}}
    if kind == "array":
        return {"kind": "boundedList", "inner": from_json_schema(s["items"]), "maxLen": s["maxItems"]} if "maxItems" in s else {"kind": "lengthCat"}
    return {"kind": "tokens", "count": 1}
