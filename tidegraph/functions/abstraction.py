"""Abstraction of numbers to finite domains: intervals between cut points, saturated counters, literals of predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import domains as dom
from tidegraph.model import Model, exprs_in, exprs_of_effect

WIDE = 256  # fixed value: domains beyond it are wide


def interval(value: Column, cuts: Sequence[float]) -> Column:
    """The number of the interval: 0 below the first cut, len(cuts) from the last one on; null stays null."""
    out = F.lit(0)
    for i, c in enumerate(sorted(cuts)):
        out = F.when(value >= c, i + 1).otherwise(out)
    return F.when(value.isNotNull(), out)


def saturated(value: Column, ceiling: int, floor: int = 0) -> Column:
    """The value as a counter that stops at ceiling + 1."""
    return F.least(F.greatest(value, F.lit(floor)), F.lit(ceiling + 1))


def input_class(value: Column) -> Column:
    """empty, blank, number or text: the class of an input."""
    return F.when(F.coalesce(value, F.lit("")) == "", "empty").when(F.trim(value) == "", "blank").when(value.rlike(r"^\s*-?[0-9]+\s*$"), "number").otherwise("text")


def cut_points(model: Model, name: str) -> list[int]:
    """Integer literals that a variable is compared with."""
    out = set()
    for t in model.transitions:
        for e in [*exprs_in(t["guard"]), *exprs_of_effect(t["effect"])]:
            if e["kind"] in ("eq", "neq", "lt", "lte", "gt", "gte") and len(e["args"]) == 2:
                for a, b in (e["args"], e["args"][::-1]):
                    if a["kind"] == "read" and a["var"] == name and b["kind"] == "lit" and isinstance(b["value"], int):
                        out.add(b["value"])
    return sorted(out)


def widened(model: Model, name: str) -> dict:
    """The integer range that literals and steps of a variable can reach within the depth bound."""
    values, step = [v for v in dom.initial_values(model.var(name)["domain"], model.var(name)["initial"]) if isinstance(v, int)], 0
    for t in model.transitions:
        for e in exprs_of_effect(t["effect"]):
            if e["kind"] in ("add", "sub") and any(a["kind"] == "read" and a["var"] == name for a in e["args"]):
                step = max([step, *(abs(a["value"]) for a in e["args"] if a["kind"] == "lit" and isinstance(a["value"], int))])
            elif e["kind"] == "lit" and isinstance(e["value"], int) and not isinstance(e["value"], bool):
                values.append(e["value"])
    values += cut_points(model, name)
    reach = step * model.max_depth
    return {"kind": "boundedInt", "min": min(values, default=0) - reach, "max": max(values, default=0) + reach}


def saturation_counter(domain: dict, ceiling: int, ambiguous: bool = False) -> tuple[dict, str]:
    """The reduced domain of a counter, and what it claims."""
    low = domain["min"] if domain["kind"] == "boundedInt" else (domain["values"] or [0])[0]
    return {"kind": "intSet", "values": list(range(low, ceiling + 2)), "overflow": domain.get("overflow") or "saturate"}, "heuristic" if ambiguous else "property-preserving"


def reduction(name: str, domain: dict) -> dict | None:
    if domain["kind"] == "intSet" or (domain["kind"] == "boundedInt" and dom.cardinality(domain) <= WIDE):
        return {"varId": name, "kind": "exact", "claim": "exact"}
    if domain["kind"] == "boundedInt":
        return {"varId": name, "kind": "deferred-range", "claim": "property-preserving"}
    return None


def refined(domain: dict, assigned: Sequence[str]) -> dict:
    """A token domain of which only literals are ever assigned becomes their enumeration."""
    return {"kind": "enum", "values": sorted(set(assigned))} if domain["kind"] == "tokens" and assigned else domain


def witnesses(rows: DataFrame, classes: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """(classes..., n, witness): for each combination of abstract classes that rows show, how many rows it has and one of
    them, the first by the columns order. One shuffle, after each task has kept its own first rows."""
    kept = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    found = rows.select(kept.alias("row"), *(c.alias(k) for k, c in classes.items()))
    first = F.min_by("row", F.struct(*(F.col(f"row.`{c}`") for c in order)))
    return found.groupBy(*classes).agg(F.count("*").alias("n"), first.alias("witness"))


def unfaithful(found: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """The rows of witnesses() whose witness is not of the class that it stands for."""
    again = found.select(F.struct(*classes).alias("of"), "witness").select("of", "witness.*").select("of", *(c.alias(k) for k, c in classes.items()))
    return again.where(~F.struct(*classes).eqNullSafe(F.col("of")))
