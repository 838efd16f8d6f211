"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import bpe, chat, lm, lzprint, mixing, neardup, periodic, secrets, spelling, substrings, tokenstore, topk, toxicity
from tidegraph.scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id, by: int):
    """crc32 of the id as text, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learns = remainder(F.col("doc_id"), 5) != 0
    score = toxicity.fit(docs, table(spark, sf_dir, "labels"), learns)(docs.select("doc_id", "text"))
    return score.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Spec(words=3, percent=85)).drop("component", "first")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), decoded=True)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.against_next(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.update(docs, new_path(spark, "ledger")))
    base = F.filter("spans", lambda x: x.kind < len(secrets.BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_path(spark, "store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), store)
    return tokenstore.read_digests(spark, store)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


#: The conversation that the formatted table has besides.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return chat_digest(rows.unionByName(probe))


def chat_digest(rows: DataFrame) -> DataFrame:
    """Each row of rows(conv_id, turn, role, text) is a message of one delta."""
    order = chat.Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.withColumn("msg", F.row_number().over(order)).select("conv_id", F.col("msg").alias("seq"), "msg", F.lit("delta").alias("kind"), "role", "text")
    out = chat.render(chat.fold(events))
    turns, said = chat.parse(F.col("formatted")), chat.learnt(F.col("formatted"), F.col("loss"))
    back = out.select("conv_id", "formatted", turns.alias("turns"), F.array_join(said, "").alias("said"))
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


CHAT_SQL = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\|(?:turn|text|end)\|>|/?s>|/?INST\])', '\1\\\2\3', 'g'))
              + length(regexp_replace(text, '([<\[])(\\*)(\|(?:turn|text|end)\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) + 23 AS n FROM c),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS said, CAST(sum(n) AS BIGINT) AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, formatted_chars FROM s
"""


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def cyclic(docs: DataFrame) -> DataFrame:
    """docs with text changed in the rows whose id's checksum ends in 0: from a place on, the words repeat the first ones
    after it. Place and period follow from the checksum."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.when(h % 10 == 0, F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", F.col("n"))))
    rows = rows.withColumn("rest", F.col("n") - F.col("a")).withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    cycle = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest").cast("int"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(cyclic(table(spark, sf_dir, "documents")))
    best = periodic.longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), 7, spelling.drop_letters).where("n > 1")
    return spelling.forms(words)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_near_duplicates, op3_mix_sources, op4_bpe, op5_fingerprints, op6_secrets, op7_token_store, op8_top_k, op9_chat, op10_lm, op11_substring_dedup, op12_periodic_runs, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": neardup.SQL, "op3_mix_sources": mixing.SQL, "op8_top_k": topk.SQL, "op9_chat": CHAT_SQL, "op11_substring_dedup": substrings.SQL}
