"""Digests, manifests and witnesses."""

from pyspark.sql import functions as F

from tidegraph.functions import abstraction
from tidegraph.sources import digests


def test_digests_do_not_depend_on_order_or_partitions(spark):
    rows = [(i % 7, f"t{i}" if i % 5 else None, [i], 0.5 * i) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, `b c` string, l array<int>, x double")
    of = lambda t: digests.digest(t, "t").first()
    first = of(df)
    assert first == of(df.orderBy(F.desc("x")).repartition(9)) == of(df.select("x", "l", "b c", "a").coalesce(1)) and first.rows == 200
    changed = [df.union(df.limit(1)), df.where("x > 0"), df.withColumn("b c", F.coalesce("b c", F.lit("~"))), df.withColumn("l", F.array(F.lit(1))), df.withColumnRenamed("a", "z")]
    assert len({of(t).digest for t in [df, *changed]}) == 6
    # Swapped parts of neighbouring columns, rows that cancel out, and nothing at all.
    pair = lambda *r: of(spark.createDataFrame(r, "a string, b string")).digest
    assert pair(("ab", "c")) != pair(("a", "bc")) and pair(("a", "b"), ("a", "b")) != pair(("c", "d"), ("c", "d")) and of(df.limit(0)).rows == 0


def test_manifests_name_what_is_stale(spark, tmp_path):
    a, b = spark.range(10).toDF("n"), spark.range(20).toDF("n")
    digests.write_manifest({"a": a, "b": b, "old": b}, str(tmp_path / "m"))
    assert digests.stale(spark, str(tmp_path / "m"), {"a": a.repartition(3), "b": b, "old": b}).collect() == []
    got = digests.stale(spark, str(tmp_path / "m"), {"a": a, "b": b.where("n <> 7"), "more": a}).collect()
    assert sorted(map(tuple, got)) == [("b", "changed"), ("more", "new"), ("old", "gone")]


def test_witnesses(spark):
    rows = spark.createDataFrame([(i, i * 3 % 50, "xy"[i % 2]) for i in range(100)] + [(100, None, "x")], "id int, n int, `k y` string")
    classes = {"band": abstraction.interval(F.col("n"), [10, 30]), "kind": F.col("`k y`")}
    found = abstraction.witnesses(rows, classes, ["id"])
    want = {}
    for r in rows.collect():
        key = (None if r.n is None else (r.n >= 10) + (r.n >= 30), r["k y"])
        want.setdefault(key, []).append(r.id)
    assert {(r.band, r.kind): (r.n, r.witness.id) for r in found.collect()} == {k: (len(v), min(v)) for k, v in want.items()}
    assert abstraction.unfaithful(found, classes).collect() == []
    wrong = found.withColumn("band", F.col("band") + 1)
    assert abstraction.unfaithful(wrong, classes).count() == found.where("band is not null").count()
