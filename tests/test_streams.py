"""Stateful processors against the batch forms, with rows out of order over several batches."""

import random

from pyspark.sql import functions as F

from tidegraph.streaming import stateful

DAY = "entity string, ts timestamp, id long, state string, trigger boolean, goal boolean"


def arrivals(spark, path, files=5, late=40):
    """Rows of three entities in files, each row up to `late` seconds later than rows that came before."""
    rng, rows = random.Random(11), []
    for i in range(400):
        kind = rng.choice("tgx")
        rows.append((rng.choice("abc"), i * 3 + rng.randint(0, late), i, kind, kind == "t", kind == "g"))
    size = len(rows) // files
    for n in range(files):
        part = spark.createDataFrame(rows[n * size : (n + 1) * size], "entity string, s long, id long, state string, trigger boolean, goal boolean")
        part.select("entity", F.timestamp_seconds("s").alias("ts"), "id", "state", "trigger", "goal").coalesce(1).write.parquet(f"{path}/{n}")
    return rows


def run(spark, path, make, schema):
    stream = spark.readStream.schema(DAY).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    out = f"{path}-{make.__name__}"
    with stateful.state_store(spark):
        q = make(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/mark").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 5
    return spark.read.schema(schema).parquet(f"{out}/rows").collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = arrivals(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    mark = max(r[1] for r in rows) * 1000 - 45_000

    def respond(stream):
        return stateful.response_stream(stream, 20_000, "45 seconds")

    def step(stream):
        return stateful.step_stream(stream, "45 seconds")

    got = sorted(map(tuple, run(spark, str(tmp_path), respond, stateful.RESPONSE)), key=str)
    table = spark.read.schema(DAY).parquet(f"{tmp_path}/*")
    batch = sorted((tuple(r) for r in stateful.responses(table, 20_000).collect()), key=str)
    want = []
    for e, t, i, kind, *_ in rows:
        if kind == "t":
            met = min((1000 * g for f, g, _, k, *_ in rows if f == e and k == "g" and t < g <= t + 20), default=None)
            want.append((e, i, 1000 * t, "missed" if met is None else "met", met))
    assert batch == sorted(want, key=str)
    assert got == sorted((r for r in want if r[2] + 20_000 <= mark), key=str) and 0 < len(got) < len(want)

    got = sorted(map(tuple, run(spark, str(tmp_path), step, stateful.STEP)))
    want = []
    for e in "abc":
        own = sorted((1000 * t, i, k) for f, t, i, k, *_ in rows if f == e and 1000 * t <= mark)
        want += [(e, t, i, pre[2], k) for pre, (t, i, k) in zip(own, own[1:], strict=False)]
    assert got == sorted(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_state_is_set_for_many_rows_at_a_time(spark, tmp_path):
    """Timers and pieces of state are few beside rows: time for each row is what made the stream slow."""
    rows = spark.range(20_000).withColumn("entity", (F.col("id") % 2500).cast("string"))
    rows.select("entity", F.timestamp_seconds(1_700_000_000 + F.hash("id") % 5000).alias("ts"), "id", F.lit("t").alias("state")).write.parquet(f"{tmp_path}/rows/0")
    stream, out = spark.readStream.schema(DAY).parquet(f"{tmp_path}/rows/*"), f"{tmp_path}/out"
    with stateful.state_store(spark):
        q = stateful.step_stream(stream, "45 seconds").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/mark").trigger(availableNow=True).start()
    q.awaitTermination()
    first, *_, end = [p.stateOperators[0] for p in q.recentProgress]
    assert 500 < first.customMetrics["numRegisteredTimers"] <= stateful.PARTS
    assert end.numRowsTotal <= 2 * stateful.PARTS and end.customMetrics["numExpiredTimers"] <= stateful.PARTS
    assert spark.read.schema(stateful.STEP).parquet(f"{out}/rows").count() > 15_000
