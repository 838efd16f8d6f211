"""Mixing sources to target weights: hash-random keys, prefix sums of sizes within each source, an exact cut per source.

The key of a row is the MD5 of its id, so the order within a source is random, the same in every run, and known to be
uniform: its first hex digits are range boundaries that need no sampling. Prefix sums are taken within each
(source, digits) range and offset by the totals of the ranges before it, so a source that holds a third of all rows is
spread over thousands of ranges and no task sees a whole source.

Nulls: a null text has size 0; a null source is a source of its own and comes last; null ids share one key. Repeated
rows count each time. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.scratch import materialize

#: A word is a run of characters other than space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name its range: 16 ** 3 ranges in each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """sources(source, source_size): one row a source. Adds weight and target.

    Sources in code point order, null last, take the weights in turn, repeating. They share share[0]/share[1] of all
    sizes; no target passes most times its source's size, and the excess is shared again by weight among the rest. That
    has one fixed point: sources in order of (cap / weight) are capped as long as an even level would overfill them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    num, den = share
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1)).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight").cast("double"))
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "caps": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    s = s.withColumn("capped", num * F.col("total") - den * F.col("caps") >= F.col("ratio") * (den * (F.col("all_weight") - F.col("weights"))))
    s = s.withColumns({"used": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)), "left": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)})
    level = (F.col("weight") * (num * F.col("total") - den * F.col("used"))).cast("double") / (den * F.col("left")).cast("double")
    return s.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = (), **shares) -> DataFrame:
    """One row for each row of docs: its id, source, size, source_size, target, taken and copies.

    taken counts the words of the row that the mix takes. A source whose target is floor(b) gives whole epochs as long
    as they fit, and in the last one rows in key order up to the budget; the row at the cut gives part of its words, so
    that the taken words of a source add up to floor(target). copies is taken / size, rounded up. carry: further columns.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), *carry)
    rows = materialize(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "sizes")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), **shares)
    here = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(here), F.lit(0)))
    g = goals.withColumnRenamed("source", "goal_source")
    ranges = ranges.join(g, F.col("source").eqNullSafe(F.col("goal_source"))).select(F.col("source").alias("range_source"), F.col("range").alias("of_range"), "offset", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.join(ranges, F.col("source").eqNullSafe(F.col("range_source")) & (F.col("range") == F.col("of_range")))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.try_divide(budget, F.col("source_size")), F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    out = out.withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.ceil(F.coalesce(F.try_divide(F.col("taken"), F.col("size")), F.lit(0))).cast("int").alias("copies"), *carry)


#: DuckDB SQL for mix() over documents. SIZES gives each row's size; the rest is shared with other tables.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w, 2 * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / CAST(w AS DOUBLE) AS ratio FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
              coalesce(sum(cap) OVER b, 0) AS caps, coalesce(sum(w) OVER b, 0) AS ws
       FROM s2 WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, CAST(3 * total - 2 * caps AS DOUBLE) >= ratio * CAST(2 * (all_w - ws) AS DOUBLE) AS capped FROM s3),
s5 AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS used, sum(CASE WHEN NOT capped THEN w END) OVER () AS rem FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * (3 * total - 2 * used) AS DOUBLE) / CAST(2 * rem AS DOUBLE) END AS target FROM s5),
r AS (SELECT d.doc_id, d.size, s6.source_size, s6.target, CAST(floor(s6.target) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""
