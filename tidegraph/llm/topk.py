"""Exact top-k search by tiled matrix products.

Vectors are cut into shards and queries into blocks, each of bounded size. A tile is one block and one shard: their
matrix product, and for each query the best k rows of the shard. The lists of a query are merged as a tree, a bounded
number at a time. Every pair of a query and a row is scored once; scores are exact integers.

Nulls: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Vectors of
different lengths don't meet. A row is known by its id: a query never meets rows with its own id. Equal query rows ask
once; query rows of one id with different vectors ask each, and each has a list of its own. Repeated rows with another id
are candidates each. Ties go to the smaller id. Components and scores beyond 64 bits count as the nearest number of 64
bits. Without queries or candidates there are no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD, BLOCK, FAN = 4096, 1024, 16


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if any is null or not finite, or the vector is."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; ids ascend, so the first of equals is the smallest."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other rows by integer inner product."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vector_col), scale).alias("q"), is_query.alias("asks")).where("vec_id is not null and q is not null")
    # Equal query rows ask once. ask tells the vectors of one id apart.
    asked = rows.where("asks").select("vec_id", "q", F.md5(F.array_join(F.transform("q", lambda v: v.cast("string")), ",")).alias("ask")).dropDuplicates(["vec_id", "ask"])
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("m")).first()
    shards, blocks = max(1, -(-size.n // SHARD)), max(1, -(-size.m // BLOCK))
    spread = F.xxhash64("vec_id", "q")
    data = rows.withColumns({"shard": F.pmod(spread, F.lit(shards)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = asked.withColumns({"block": F.pmod(spread, F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    # A cogroup of a table with itself needs columns of its own on either side.
    data = data.select("shard", "block", F.expr("vec_id + 0").alias("id"), F.transform("q", lambda v: v + 0).alias("v"))
    asked = asked.select("shard", "block", "vec_id", "ask", "q")

    def product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
        # Doubles hold these sums exactly below 2 ** 53; beyond it integers of 64 bits do, or of any size.
        most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(m.astype(np.float64)).max(initial=0)) * q.shape[1]
        if most < 2**53:
            return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
        if most < 2**62:
            return q @ m.T
        return np.clip(q.astype(object) @ m.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)

    def tile(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for d in set(left["q"].map(len)) & set(right["v"].map(len)):
            a, b = left[left["q"].map(len) == d], right[right["v"].map(len) == d].sort_values("id", kind="stable")
            ids = b["id"].to_numpy()
            scores = product(np.stack(a["q"]) if d else np.zeros((len(a), 0), np.int64), np.stack(b["v"]) if d else np.zeros((len(b), 0), np.int64))
            for q, ask, s in zip(a["vec_id"].to_numpy(), a["ask"], scores, strict=True):
                others = np.flatnonzero(ids != q)
                at = best(s, ids, k) if len(others) == len(ids) else others[best(s[others], ids[others], k)]
                found += zip([q] * len(at), [ask] * len(at), ids[at].tolist(), s[at].tolist(), strict=True)
        out = pd.DataFrame(found, columns=["query_id", "ask", "vec_id", "score"])
        return out.assign(shard=key[0])

    lists = asked.groupBy("shard", "block").cogroup(data.groupBy("shard", "block")).applyInPandas(tile, "query_id long, ask string, vec_id long, score long, shard int")
    groups = shards
    while True:
        groups = -(-groups // FAN)
        merged = lists.withColumn("shard", F.pmod("shard", F.lit(groups)).cast("int"))
        order = Window.partitionBy("query_id", "ask", "shard").orderBy(F.desc("score"), "vec_id")
        lists = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if groups == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.q AS asked, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
