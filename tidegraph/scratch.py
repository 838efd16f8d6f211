"""Tables written once and read several times, in the folder that all executors share.

Writing cuts the lineage, so a lost executor costs a re-read and not a recomputation, and whatever is derived from the
table sees one and the same content.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark's default for the most buckets of a table.
MOST_BUCKETS = 100_000
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
    return _own[app]


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the program ends."""
    path = f"{shared_dir(spark)}/tidegraph/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, column: str, buckets: int, name: str = "table") -> DataFrame:
    """As materialize(), but dealt to buckets by a column: joins on it leave the table where it lies. With more
    buckets than Spark allows, each just holds more rows."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"tidegraph_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(min(buckets, MOST_BUCKETS), column).saveAsTable(table)
    _tables.append((spark, table))
    return spark.table(table)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def settled(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """materialize(make()); the tables that make() wrote on the way are deleted once the result is there."""
    written, tables = len(_written), len(_tables)
    out = materialize(make(), name)
    gone = _written[written:-1]
    del _written[written:-1]
    for spark, table in _tables[tables:]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    del _tables[tables:]
    for spark, path in gone:
        delete(spark, path)
    return out


@atexit.register
def _clean() -> None:
    for spark, table in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session has ended, and its catalog with it
            break
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            return
