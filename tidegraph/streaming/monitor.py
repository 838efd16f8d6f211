"""Online monitors: invariants of each observed snapshot, and bounded response, over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESPONSE_OUT = "entity string, trigger_tick long, status string"
RESPONSE_STATE = "waiting array<long>, left array<int>"


def monitor(snapshots: DataFrame, invariants: dict[str, Column | None]) -> DataFrame:
    """A row for each snapshot and invariant: ok, violated, or skipped where it cannot be observed (None, or null).

    Stateless, so it runs on a stream as on a table; a skip makes ok false, as a violation does."""
    checks = F.array(*(F.struct(F.lit(n).alias("invariant"), F.lit(None).cast("boolean").alias("holds") if c is None else c.cast("boolean").alias("holds")) for n, c in invariants.items()))
    out = snapshots.withColumn("_check", F.explode(checks))
    status = F.when(F.col("_check.holds").isNull(), "skipped").when(F.col("_check.holds"), "ok").otherwise("violated")
    return out.select(*snapshots.columns, F.col("_check.invariant").alias("invariant"), status.alias("status"), F.coalesce(F.col("_check.holds"), F.lit(False)).alias("ok"))


def responses(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState, within: int) -> Iterator[pd.DataFrame]:
    """For one entity: each trigger must meet a goal within so many of its next rows. Waiting triggers are the state."""
    waiting, left = state.get if state.exists else ([], [])
    waiting, left, out = list(waiting), list(left), []
    for frame in rows:
        for tick, trig, goal in frame.sort_values("tick")[["tick", "trigger", "goal"]].itertuples(index=False):
            if goal:
                out += [(key[0], t, "met") for t in waiting]
                waiting, left = [], []
            else:
                left = [n - 1 for n in left]
                out += [(key[0], t, "missed") for t, n in zip(waiting, left, strict=True) if n <= 0]
                keep = [i for i, n in enumerate(left) if n > 0]
                waiting, left = [waiting[i] for i in keep], [left[i] for i in keep]
            if trig and not goal:
                waiting.append(int(tick))
                left.append(within)
    state.update((waiting, left))
    yield pd.DataFrame(out, columns=["entity", "trigger_tick", "status"])


def response_monitor(stream: DataFrame, within: int) -> DataFrame:
    """stream(entity, tick, trigger, goal) to one row for each trigger once it is met or missed. At most `within`
    triggers of an entity wait at a time, so the state is bounded."""
    return stream.groupBy("entity").applyInPandasWithState(lambda k, r, s: responses(k, r, s, within), RESPONSE_OUT, RESPONSE_STATE, "append", GroupStateTimeout.NoTimeout)


def step_monitor(stream: DataFrame, forbidden: Column) -> DataFrame:
    """Steps (entity, tick, pre, post) that are forbidden, as they come: AG over edges."""
    return stream.where(F.coalesce(forbidden, F.lit(False)))
