"""Stateful processors over streams whose rows come out of order within a watermark: bounded response, and steps in order.

Rows wait as state until the watermark has passed; event-time timers wake them then. What is given out depends on the rows
alone, not on how they fall into batches, as no row at or before the watermark is still to come. State holds the rows of a
deadline and the allowed delay, and each entity's last state, not the history. Times count in milliseconds.

Entities are dealt to parts by a hash. The rows of a part wait together, in pieces of many rows, and are looked at together,
so that state is written and timers are set for each part and batch, not for each row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

RESPONSE = "entity string, id long, at long, status string, met_at long"
STEP = "entity string, at long, id long, pre string, post string"


#: Parts that entities are dealt to. A checkpoint is bound to it.
PARTS = 1024
#: Most rows of a piece of state, or of a frame that is given out.
PIECE = 10_000
_ENTITY, _TIMED = ("entity", pa.string()), [("at", pa.int64()), ("id", pa.int64()), ("bare", pa.bool_())]


class _Parted(StatefulProcessor):
    """Rows of many entities that wait together. Subclasses say what waits, when a batch's rows are due first, and what to
    do with those whose time the watermark has passed. bare: the id is null."""

    #: The columns of each list of rows.
    KEPT: dict[str, pa.Schema] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.passed = handle, {}
        self.pieces = {name: handle.getMapState(name, "name string", "piece binary") for name in self.KEPT}

    def _add(self, name: str, rows: pd.DataFrame) -> None:
        """Each piece has a key of its own: what is appended to a list makes Spark read all of it."""
        for i in range(0, len(rows), PIECE):
            piece = pa.RecordBatch.from_pandas(rows.iloc[i : i + PIECE], self.KEPT[name], preserve_index=False)
            self.pieces[name].updateValue((uuid.uuid4().hex,), (piece.serialize().to_pybytes(),))

    def _put(self, name: str, rows: pd.DataFrame) -> None:
        self.pieces[name].clear()
        self._add(name, rows)

    def _read(self, name: str) -> pd.DataFrame:
        state, schema = self.pieces[name], self.KEPT[name]
        names = list(state.keys()) if state.exists() else []
        return pa.Table.from_batches([pa.ipc.read_record_batch(state.getValue(n)[0], schema) for n in names], schema).to_pandas()

    def _wake(self, due: int | None, mark: int | None = None) -> None:
        """Has the part looked at as soon as the watermark is at `due`, whether timers go off at their time or past it.
        One that is set again while it goes off is lost."""
        if due is not None:
            self.handle.registerTimer(due - 1)
            if due - 1 == mark:
                self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = [due for frame in rows if (due := self.hold(frame[frame["at"].notna()].astype({"at": "int64"}))) is not None]
        self._wake(min(first, default=None))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.passed.get(key) == mark:
            return
        self.passed[key] = mark
        out, due = self.drain(mark)
        self._wake(due, mark)
        for i in range(0, 0 if out is None else len(out), PIECE):
            yield out.iloc[i : i + PIECE]

    def hold(self, rows: pd.DataFrame) -> int | None:
        raise NotImplementedError

    def drain(self, mark: int) -> tuple[pd.DataFrame | None, int | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _ids(rows: pd.DataFrame) -> pd.Series:
    return rows["id"].astype("Int64").mask(rows["bare"])


class BoundedResponse(_Parted):
    """Rows (entity, at, id, trigger, goal): a trigger is met by the entity's first goal after it, within so many
    milliseconds, or else missed. Each is given out once the watermark has passed its deadline. Nothing meets a trigger of
    no entity."""

    KEPT = {"waiting": pa.schema([_ENTITY, *_TIMED]), "goals": pa.schema([_ENTITY, _TIMED[0]])}

    def __init__(self, within: int):
        self.within = within

    def _due(self, waiting: pd.DataFrame, goals: pd.DataFrame) -> int | None:
        """The first deadline; with none, when the last goal can go."""
        return int(waiting["at"].min()) + self.within if len(waiting) else int(goals["at"].max()) if len(goals) else None

    def hold(self, rows: pd.DataFrame) -> int | None:
        waiting, goals = rows[rows["trigger"]], rows[rows["goal"] & rows["entity"].notna()]
        self._add("waiting", waiting)
        self._add("goals", goals)
        return self._due(waiting, goals)

    def drain(self, mark: int) -> tuple[pd.DataFrame | None, int | None]:
        waiting, goals = self._read("waiting"), self._read("goals")
        over = waiting["at"] + self.within <= mark
        due, left, out = waiting[over], waiting[~over], None
        if len(due):
            entity = pd.factorize(pd.concat([due["entity"], goals["entity"]]))[0]
            asked = due.assign(of=entity[: len(due)]).sort_values("at")
            met = pd.DataFrame({"of": entity[len(due) :], "at": goals["at"].to_numpy(), "met_at": goals["at"].to_numpy()}).sort_values("at")
            out = pd.merge_asof(asked, met, on="at", by="of", direction="forward", allow_exact_matches=False, tolerance=self.within)
            out = out.assign(id=_ids(out), status=np.where(out["met_at"].isna(), "missed", "met"), met_at=out["met_at"].astype("Int64"))
            out = out[["entity", "id", "at", "status", "met_at"]]
            self._put("waiting", left)
        kept = goals[goals["at"] > min([mark, *left["at"]])]
        if len(kept) < len(goals):
            self._put("goals", kept)
        return out, self._due(left, kept)


class OrderedSteps(_Parted):
    """Rows (entity, at, id, state): consecutive states of an entity in the order of time, id and state, nulls last, given
    out once the watermark has passed the later one."""

    KEPT = dict.fromkeys(("held", "last"), pa.schema([_ENTITY, *_TIMED, ("state", pa.string())]))

    def hold(self, rows: pd.DataFrame) -> int | None:
        self._add("held", rows)
        return int(rows["at"].min()) if len(rows) else None

    def drain(self, mark: int) -> tuple[pd.DataFrame | None, int | None]:
        held = self._read("held")
        ready, left, out = held[held["at"] <= mark], held[held["at"] > mark], None
        if len(ready):
            # An entity's last row is before all that waited since.
            rows = pd.concat([self._read("last"), ready])
            entity, state = pd.factorize(rows["entity"], use_na_sentinel=False)[0], pd.factorize(rows["state"], sort=True)[0]
            state = np.where(state < 0, len(rows), state)
            order = np.lexsort((state, rows["id"], rows["bare"], rows["at"], entity))
            rows, entity = rows.iloc[order], entity[order]
            after = np.concatenate([[False], entity[1:] == entity[:-1]])
            out = rows.assign(id=_ids(rows), pre=rows["state"].shift()).rename(columns={"state": "post"})[after]
            out = out[["entity", "at", "id", "pre", "post"]]
            self._put("last", rows[np.concatenate([~after[1:], [True]])])
            self._put("held", left)
        return out, int(left["at"].min()) if len(left) else None


@contextmanager
def state_store(spark: SparkSession):
    """A store for typed state while a query is started; the session's own is set again after that."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def instant(ts: Column) -> Column:
    """A time stamp with or without zone as one with, in whole milliseconds; one without counts as UTC."""
    zero = F.lit("1970-01-01 00:00:00")
    return F.timestamp_millis(F.timestamp_diff("MILLISECOND", zero.cast("timestamp"), ts.cast("timestamp")))


def millis(ts: Column) -> Column:
    return F.unix_millis(instant(ts))


def _parted(rows: DataFrame, delay: str, *columns: Column) -> DataFrame:
    """The columns that both processors hold and the given ones, with a watermark."""
    entity = F.col("entity").cast("string")
    timed = rows.withColumn("ts", instant(F.col("ts"))).withWatermark("ts", delay)
    return timed.select(F.pmod(F.xxhash64(entity), F.lit(PARTS)).cast("int").alias("part"), entity.alias("entity"), "ts", F.unix_millis("ts").alias("at"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNull().alias("bare"), *columns)


def response_stream(rows: DataFrame, within: int, delay: str) -> DataFrame:
    """rows(entity, ts, id, trigger, goal), a stream, to RESPONSE. Start the query inside state_store()."""
    timed = _parted(rows, delay, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("trigger", "goal")))
    # Asking for the time too keeps this filter above the watermark, which all rows move.
    wanted = timed.where("trigger or goal or ts is null")
    return wanted.groupBy("part").transformWithStateInPandas(BoundedResponse(within), RESPONSE, "append", "EventTime")


def responses(rows: DataFrame, within: int) -> DataFrame:
    """rows(entity, ts, id, trigger, goal), a table, to RESPONSE for all triggers, as if the watermark had passed all."""
    timed = rows.select(F.col("entity").cast("string").alias("entity"), millis(F.col("ts")).alias("at"), "id", "trigger", "goal")
    after = Window.partitionBy("entity").orderBy("at").rangeBetween(1, within)
    met = F.min(F.when(F.col("goal"), F.col("at"))).over(after)
    out = timed.where("trigger or goal").withColumn("met_at", met).where("trigger")
    return out.select("entity", "id", "at", F.when(F.col("met_at").isNull(), "missed").otherwise("met").alias("status"), "met_at")


def step_stream(rows: DataFrame, delay: str) -> DataFrame:
    """rows(entity, ts, id, state), a stream, to STEP; step predicates apply to its rows. Start it inside state_store()."""
    return _parted(rows, delay, F.col("state")).groupBy("part").transformWithStateInPandas(OrderedSteps(), STEP, "append", "EventTime")
