"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every text is addressed by its SHA-256. The ledger, a folder that outlives the program, holds, for each (blob, rule version) that was ever scanned, the spans
found. A run scans the blobs whose pair is not in the ledger, each once however many paths hold it, and joins the
findings of old and new pairs back to all paths.

Nulls: a null text is the empty blob; null ids and repeated rows keep their rows. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.scratch import exists


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 0  # characters that it must have


#: The base rules and, after them, formats that announce themselves.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,kind:int,end:int>>"
LEDGER = f"blob binary, spans {SPANS}, rule_version string"
BLOCK = 256  # matches that are folded together


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(tuple(map(tuple, rules))).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _long_enough(rule: Rule) -> str:
    """A pattern that every text with a kept match has a match of; it lets most texts pass by."""
    if rule.kind == "hex":
        return r"[0-9a-f]{%d}" % rule.least
    if rule.kind == "access":
        return r"AKIA[A-Z0-9]{%d}" % (rule.least - 4)
    return rule.pattern


def with_spans(rows: DataFrame, rule: Rule, kind: int, text: str = "text") -> DataFrame:
    """Adds spans<kind>: the leftmost non-overlapping matches whose group is long enough, as array of (start, kind, end)
    in code points.

    The gaps between matches and the matches themselves alternate, so running sums of their lengths give the places. They
    are taken over blocks of BLOCK matches, so that the work grows with the number of matches. Each step is a projection
    of its own: the matches are looked for once.
    """
    name, column = f"spans{kind}", F.col(text)
    gaps, whole = F.split(column, rule.pattern, -1), F.regexp_extract_all(column, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(column, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    each = F.zip_with(F.zip_with(whole, F.slice(gaps, F.lit(1), F.size(whole)), lambda hit, gap: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))), group, lambda x, part: F.struct(x.gap.alias("gap"), x.hit.alias("hit"), F.length(part).alias("part")))
    none = F.array().cast(SPANS)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    block = lambda xs, n: F.slice(xs, n * BLOCK + 1, F.lit(BLOCK))

    def step(at: Column, x: Column) -> Column:
        start = at.pos + x.gap
        end = start + x.hit
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("pos"), F.when(x.part >= rule.least, F.array_append(at.out, span)).otherwise(at.out).alias("out"))

    found = rows.withColumn("_each", F.when(column.rlike(_long_enough(rule)), each).otherwise(F.array().cast("array<struct<gap:int,hit:int,part:int>>")))
    found = found.withColumn("_blocks", F.when(F.size("_each") > 0, F.sequence(F.lit(0), F.floor((F.size("_each") - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")))
    found = found.withColumn("_sums", F.transform("_blocks", lambda n: total(F.transform(block(F.col("_each"), n), lambda x: x.gap + x.hit))))
    spans = F.transform("_blocks", lambda n: F.aggregate(block(F.col("_each"), n), F.struct(total(F.slice(F.col("_sums"), F.lit(1), n)).alias("pos"), none.alias("out")), step, lambda at: at.out))
    return found.withColumn(name, F.flatten(spans)).drop("_each", "_blocks", "_sums")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs(blob, text) to ledger rows: spans by start, then by the order of the rules."""
    rows = blobs.select("blob", "text")
    for k, r in enumerate(rules):
        rows = with_spans(rows, r, k)
    found = F.array_sort(F.concat(*(F.col(f"spans{k}") for k in range(len(rules)))))
    return rows.select("blob", F.lit(rule_version(rules)).alias("rule_version"), found.alias("spans"))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger rows of the blobs of docs whose (blob, rule version) is not in the ledger yet."""
    blobs = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version(rules)).select("blob"), "blob", "left_anti")
    return scan(blobs, rules)


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger at path after scanning what is new in docs: a Parquet folder by rule version that outlives the program.
    Only the new pairs are written; what is there stays as it is. Runs that share a ledger take turns."""
    spark = docs.sparkSession
    read = lambda: spark.read.schema(LEDGER).parquet(path)
    new = scan_new(docs, read() if exists(spark, path) else None, rules, text_col)
    new.write.mode("append").option("compression", "zstd").partitionBy("rule_version").parquet(path)
    return read()


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For every row of docs (its path) the columns keep, blob and spans. Blobs without findings don't travel.

    A blob that a third of all paths hold makes its join partition large; adaptive execution splits it.
    """
    paths = docs.select(*keep, blob_of(F.col(text_col)).alias("blob"))
    hits = ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(hits, "blob", "left").select(*keep, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with every stretch that spans, by start, cover replaced by mark; overlapping spans make one stretch.

    The text is cut before every BLOCK spans, so that what a span is looked for in stays short. A block begins where the
    spans before it end."""
    last = lambda xs: F.array_max(F.transform(xs, lambda x: x.end))
    own = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")),
        lambda n: F.struct(F.slice(spans, n * BLOCK + 1, F.lit(BLOCK)).alias("own"), F.coalesce(last(F.slice(spans, F.lit(1), n * BLOCK)), F.lit(0)).alias("at")),
    )
    cut = F.transform(own, lambda b: F.struct(b.own.alias("own"), b["at"].alias("at"), F.substring(text, b["at"] + 1, F.greatest(last(b.own) - b["at"], F.lit(0))).alias("part")))

    def folded(b: Column) -> Column:
        def step(at: Column, x: Column) -> Column:
            gap = F.substring(b.part, at.pos - b["at"] + 1, x.start - at.pos)
            return F.struct(F.greatest(at.pos, x.end).alias("pos"), F.when(x.start < at.pos, at.out).otherwise(F.concat(at.out, gap, F.lit(mark))).alias("out"))

        return F.aggregate(b.own, F.struct(b["at"].alias("pos"), F.lit("").alias("out")), step, lambda at: at.out)

    whole = F.concat(F.array_join(F.transform(cut, folded), ""), F.substring(text, last(spans) + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start, x.end)), ",")
