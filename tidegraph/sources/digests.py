"""Order-free digests of tables, and manifests that tell which inputs have changed since.

A row's hash is part of the MD5 of its columns as text; a table's digest has how many rows there are and the sum and the
exclusive or of their hashes. So neither order, files nor partitions matter, repeated rows do, and one pass with partial
sums in every task is enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, rows long, digest string"


def row_text(columns: Sequence[Column]) -> Column:
    """Columns as text, each with its length before it, so that no two rows of different values look alike; nulls as ~."""
    text = lambda c: c.cast("string")
    return F.concat(*(F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("~")) for c in columns))


def digest(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (name, rows, digest). columns: those that count, all by default, in the order of their names; values of nested
    types count as JSON text."""
    names = sorted(columns or df.columns)
    nested = lambda c: df.schema[c].dataType.typeName() in ("struct", "array", "map")
    text = row_text([F.to_json(F.col(f"`{c}`")) if nested(c) else F.col(f"`{c}`") for c in names])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    found = df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("mix"))
    parts = [F.lit(",".join(names)), F.col("rows").cast("string"), F.coalesce(F.col("sum").cast("string"), F.lit("0")), F.coalesce(F.col("mix").cast("string"), F.lit("0"))]
    return found.select(F.lit(name).alias("name"), "rows", F.md5(F.concat_ws("|", *parts)).alias("digest"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """MANIFEST of tables by name."""
    return reduce(DataFrame.unionByName, (digest(df, name) for name, df in sorted(tables.items())))


def write_manifest(tables: dict[str, DataFrame], path: str) -> None:
    manifest(tables).coalesce(1).write.mode("overwrite").json(path)


def stale(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, state) of tables that are not as the manifest at path says: changed, new or gone."""
    was, now = spark.read.schema(MANIFEST).json(path), manifest(tables)
    both = was.select("name", F.col("digest").alias("was")).join(now.select("name", F.col("digest").alias("now")), "name", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return both.select("name", state.alias("state")).where("state is not null")
