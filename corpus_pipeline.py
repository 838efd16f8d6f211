"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's docs. All but the last return the columns of documents, whatever these are and are called.

Rows count, not ids: ids may be null or repeat. A null text is empty. Empty tables give empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import bpe, mixing, neardup, secrets, toxicity
from tidegraph.llm.queries import remainder, table, vocabulary
from tidegraph.scratch import new_path, settled

#: Documents with this score or more go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents that are here, but for the fifth that is held out to measure the fit. With too few
    labels to fit on, all documents stay. Repeated rows go or stay together; null and empty texts are scored too."""
    score = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return score(docs.select(F.struct("*").alias("row"), "text")).where(F.col("score") < TOXIC).select("row.*")


def _key() -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("|"), F.coalesce("text", F.lit("")))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: one with the smallest id, null ids last. Rows are compared by their
    texts, so different texts under one id are judged each. Of rows with one id and text one stays, the
    least as JSON text, so columns of any type may come along, maps too. Texts without words are no
    near-duplicates of anything: one row for each id stays."""
    found = neardup.near_duplicates(docs.select("doc_id", "text", _key().alias("key")), neardup.Spec(words=5, percent=80), carry=("key",))
    firsts = found.where("first")
    kept = firsts.where("component is not null").groupBy("component").agg(F.min("key").alias("key")).select("key")
    kept = kept.unionByName(firsts.where("component is null").select("key").distinct())
    rows = docs.select(F.struct("*").alias("row"), _key().alias("key")).join(kept, "key", "left_semi")
    return rows.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark; all rows stay. n_chars follows the text where that changes."""
    ledger = secrets.update(docs, new_path(spark, "ledger"))
    rows = docs.select(F.struct("*").alias("row"), secrets.blob_of(F.col("text")).alias("blob"))
    found = rows.join(ledger.where(F.size("spans") > 0).select("blob", "spans"), "blob", "left")
    found = found.select("row", "spans", F.when(F.col("spans").isNotNull(), secrets.redact(F.col("row.text"), F.col("spans"))).alias("clean"))
    changed = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("clean").cast(docs.schema["n_chars"].dataType))
    return found.select(F.when(F.col("clean").isNull(), F.col("row")).otherwise(changed).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. The one at a source's cut counts if the mix takes half of it or more. A row
    without words costs nothing and stays once. A null source is a source."""
    mixed = mixing.mix(docs.select("doc_id", "source", "text", F.struct("*").alias("row")), carry=("row",))
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(1).cast("int")
    return mixed.withColumn("times", times).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row: ids as little-endian unsigned 32-bit integers. An empty text has none."""
    out = bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: Trained trees and a tokenizer are no SQL; the tests hold every stage, and all of them together, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way is deleted once its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return docs
