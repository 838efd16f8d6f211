"""Graphs observed in tables: the states that rows show, and the steps between consecutive rows of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.model import Model
from tidegraph.sources.rows import with_state

SEPARATOR = "|"


def key_of(*columns: Column) -> Column:
    """A readable state key: the columns as text, nulls as ~."""
    return F.concat_ws(SEPARATOR, *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns))


def steps(rows: DataFrame, entity: Sequence[str], order: Sequence[str], state: Column, differing: bool = True) -> DataFrame:
    """(entity..., pre, post, tick): consecutive states of each entity, ties in order broken by the state. differing:
    only steps that change it. One shuffle by entity; a window needs an entity's rows in one task, so take entities that
    stay small, such as a user's day."""
    w = Window.partitionBy(*entity).orderBy(*order, "post")
    r = rows.select(*dict.fromkeys([*entity, *order]), state.alias("post")).withColumn("pre", F.lag("post").over(w))
    r = r.where("pre is not null")
    return (r.where("pre <> post") if differing else r).select(*entity, "pre", "post", F.col(order[0]).alias("tick"))


def graph(rows: DataFrame, entity: Sequence[str], order: Sequence[str], state: Column) -> tuple[DataFrame, DataFrame]:
    """nodes(key) on differing steps, and distinct edges(pre, post)."""
    edges = steps(rows, entity, order, state).select("pre", "post").distinct()
    nodes = edges.select(F.explode(F.array("pre", "post")).alias("key")).distinct()
    return nodes, edges


def user_days(events: DataFrame) -> DataFrame:
    """events with the day of each row; a user's day is an entity."""
    return events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def event_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States (user, day, event type), steps between differing consecutive events of a user's day."""
    rows = user_days(events)
    return graph(rows, ["user_id", "day"], ["ts", "event_id"], key_of(F.col("user_id"), F.col("day"), F.col("event_type")))


def event_type(key: Column) -> Column:
    return F.element_at(F.split(key, r"\|"), -1)


def status_graph(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States (customer, year, status, priority), steps between a customer's differing consecutive orders of a year."""
    rows = orders.withColumn("year", F.date_format("o_orderdate", "yyyy"))
    return graph(rows, ["o_custkey", "year"], ["o_orderdate", "o_orderkey"], key_of(F.col("o_custkey"), F.col("year"), F.col("o_orderstatus"), F.col("o_orderpriority")))


def recorded(rows: DataFrame, entity: Sequence[str], order: Sequence[str], model: Model, columns: dict[str, Column], transition: Column) -> DataFrame:
    """edges(entity..., tick, tid, pre_s, post_s) as step predicates read them: consecutive rows of each entity as states of
    a row_model(), and the number of the transition that the later row names (null if the model has none of that id).
    Ties in order are broken by the state."""
    w = Window.partitionBy(*entity).orderBy(*order, F.to_json("post_s"))
    ids = F.create_map(*(x for i, t in enumerate(model.sorted_transitions) for x in (F.lit(t["id"]), F.lit(i)))) if model.transitions else None
    tid = F.lit(None).cast("int") if ids is None else F.element_at(ids, F.col("_transition"))
    r = with_state(rows.withColumn("_transition", transition), model, columns).withColumnRenamed("s", "post_s")
    r = r.select(*dict.fromkeys([*entity, *order]), tid.alias("tid"), "post_s").withColumn("pre_s", F.lag("post_s").over(w))
    return r.where("pre_s is not null").select(*entity, F.col(order[0]).alias("tick"), "tid", "pre_s", "post_s")
