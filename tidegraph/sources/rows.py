"""Table rows as states: a model whose variables are columns, and the state struct of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.exprs import Scope
from tidegraph.model import Model
from tidegraph.operators.effects import Effects, state_ddl


def row_model(name: str, columns: dict[str, dict], max_pending: int = 2, transitions: dict[str, str] | None = None) -> Model:
    """Variables with the given domains. Values outside them are kept as they are. transitions: the class of each name that
    an observed step can have; what such a step does is in the rows, not in the model."""
    variables = tuple({"id": k, "domain": d, "origin": "table", "scope": {"kind": "global"}, "initial": [], **({"role": {"kind": "pending-queue"}} if k == "queue" else {})} for k, d in columns.items())
    seen = tuple({"id": k, "cls": c, "label": {"kind": "observed"}, "source": [], "guard": {"kind": "lit", "value": True}, "effect": {"kind": "seq", "effects": []}, "reads": [], "writes": []} for k, c in (transitions or {}).items())
    return Model(name, variables, seen, 0, max_pending)


def with_state(df: DataFrame, model: Model, columns: dict[str, Column]) -> DataFrame:
    return df.withColumn("s", F.struct(*(columns[v["id"]].alias(f"v{i}") for i, v in enumerate(model.vars))).cast(state_ddl(model)))


def value(model: Model, expr: dict) -> Column:
    """An expression over the state column s."""
    return Scope(model, F.col("s")).eval(expr).col


def outcomes(df: DataFrame, model: Model, effect: dict) -> DataFrame:
    """df with a row for each outcome of an effect on s (post); rows that the effect blocks go."""
    return df.withColumn("post", F.explode(Effects(model).apply(effect, F.col("s"), F.col("s"))))
