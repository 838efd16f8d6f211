"""Readers and writers of model, property, trace and report artifacts."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.model import EXPR_KINDS, Model, ModelError, exprs_in, parse_model
from tidegraph.plans.slicing import atoms

TRACE = "trace string, step int, transition_id string, pre string, post string"
REPORT = "property string, status string, boundedness string, message string, replayable boolean, trace array<string>"
FORMULAS = frozenset("atom fnot fand for EX AX EF AF EG AG EU AU".split())
STEP_KEYS = frozenset("transitionId transitionClass labelKind enqueued resolved changed changedTo opId continuation opArgs".split())


def read_models(spark: SparkSession, path: str) -> list[Model]:
    """Models from JSON files, one a file, wherever Spark reads from. Models are small and compiled on the driver."""
    return [parse_model(r.value) for r in spark.read.text(path, wholetext=True).collect()]


def _check_formula(f: dict, name: str) -> None:
    if not isinstance(f, dict) or f.get("kind") not in FORMULAS:
        raise ModelError(f"{name}: unknown formula {f!r}")
    for a in atoms(f) if f["kind"] == "atom" else ():
        check_expr(a, name)
    for x in [*f.get("args", ()), *(f[k] for k in ("arg", "left", "right") if k in f)]:
        _check_formula(x, name)


def check_expr(e: dict, name: str) -> None:
    for x in exprs_in(e):
        if not isinstance(x, dict) or x.get("kind") not in EXPR_KINDS:
            raise ModelError(f"{name}: unknown expression {x!r}")
    json.dumps(e)  # functions and other live objects cannot be written down


def _check_step(p: dict, name: str) -> None:
    flat = p.get("step", p) if "step" in p else p
    if unknown := set(flat) - STEP_KEYS:
        raise ModelError(f"{name}: unknown step predicates {sorted(unknown)}")
    for k in ("pre", "post"):
        if p.get(k) is not None:
            check_expr(p[k], name)


def parse_properties(source: str | dict) -> list[dict]:
    """Properties of an artifact, checked to be plain data of known kinds."""
    raw = json.loads(source) if isinstance(source, str) else source
    if raw.get("schemaVersion") != 1:
        raise ModelError(f"unsupported schemaVersion {raw.get('schemaVersion')}")
    for p in raw["properties"]:
        name = p.get("name")
        if not name:
            raise ModelError("a property needs a name")
        if p["kind"] == "temporal":
            _check_formula(p["formula"], name)
            for c in p.get("fairness") or ():
                _check_formula(c["condition"], name)
        elif p["kind"] == "alwaysStep":
            _check_step(p["predicate"], name)
        elif p["kind"] == "leadsToWithin":
            _check_step(p["trigger"], name)
            check_expr(p["goal"], name)
        else:
            raise ModelError(f"{name}: unknown property kind {p['kind']}")
    return raw["properties"]


class Registry:
    """Properties that modules register; names are unique, groups prefix them."""

    def __init__(self):
        self.properties: dict[str, dict] = {}
        self._prefix = ""

    def add(self, prop: dict) -> dict:
        named = {**prop, "name": self._prefix + prop["name"]}
        if named["name"] in self.properties:
            raise ModelError(f"duplicate property {named['name']}")
        self.properties[named["name"]] = named
        return named

    def group(self, prefix: str, add) -> None:
        before, self._prefix = self._prefix, f"{self._prefix}{prefix}/"
        try:
            add()
        finally:
            self._prefix = before

    def harvest(self) -> list[dict]:
        out, self.properties = list(self.properties.values()), {}
        return out


registry = Registry()


def load_properties(*modules: str) -> list[dict]:
    """Imports modules that register properties, and harvests them."""
    for m in modules:
        importlib.reload(importlib.import_module(m))
    return registry.harvest()


def write_traces(steps: DataFrame, path: str) -> None:
    """steps as of TRACE, one folder a trace."""
    steps.select(*(c.split()[0] for c in TRACE.split(", "))).write.partitionBy("trace").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts of JSON reports; rows that lack a property or a known status are refused."""
    rows = spark.read.schema(REPORT).json(path)
    known = F.col("status").isin("verified", "verified-within-bounds", "violated", "vacuous-warning", "error")
    ok = F.col("property").isNotNull() & F.coalesce(known, F.lit(False))
    return rows.withColumn("status", F.when(ok, F.col("status")).otherwise(F.raise_error(F.lit("not a verdict"))))


def trust_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Properties whose status differs between two reports: (property, was, now)."""
    a, b = before.select("property", F.col("status").alias("was")), after.select("property", F.col("status").alias("now"))
    return a.join(b, "property", "full").where(~F.col("was").eqNullSafe(F.col("now")))
