"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed from left to right: each phrase is the shortest stretch that is no phrase yet. The set of
phrases stands for what a dictionary compressor learns from the text. Its hashes give SAMPLES minima, one for each class
of hashes (empty classes borrow from the next full one), of 16 bits each. The share of equal samples estimates how alike
two sets are.

Nulls: a null text is empty; its fingerprint is all ones and alike only to its equals. Null ids come first in id order,
ties by a hash of the text and then by text. A table of one row is its own next document. Repeated rows are documents of their own. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.scratch import materialize

SAMPLES = 128


def parse(raw: bytes, at: int, start: int, end: int, phrases: set[bytes]) -> int:
    """Adds the phrases that end in raw[at:end] to phrases; start is where the open one began. Returns the new start."""
    add = phrases.add
    for stop in range(at + 1, end + 1):
        p = raw[start:stop]
        if p not in phrases:
            add(p)
            start = stop
    return start


def fingerprint(phrases: set[bytes]) -> bytes:
    out = np.full(SAMPLES, 0xFFFF, "<u2")
    if phrases:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))
        least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, (h % np.uint64(SAMPLES)).astype(np.int64), h >> np.uint64(7))
        full = np.flatnonzero(least != np.iinfo(np.uint64).max)
        to = full[np.searchsorted(full, np.arange(SAMPLES)) % len(full)]
        far = (to - np.arange(SAMPLES)) % SAMPLES  # how far a sample was borrowed tells it from its lender
        v = least[to] * np.uint64(0x9E3779B97F4A7C15) + far.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out = np.minimum(v >> np.uint64(48), np.uint64(0xFFFE)).astype("<u2")
    return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both_fingerprints(text: str, new: str) -> tuple[bytes, bytes]:
    """Of a text and its edited text. What they begin with alike is parsed once."""
    keep = len(text) - len(text) // 2
    raw, other, cut = text.encode(), new.encode(), len(text[:keep].encode())
    phrases: set[bytes] = set()
    start = parse(raw, 0, 0, cut, phrases)
    again = set(phrases)
    parse(raw, cut, start, len(raw), phrases)
    parse(other, cut, start, len(other), again)
    return fingerprint(phrases), fingerprint(again)


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep and the fingerprint (hexadecimal) of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(len(keep)):
                raw, phrases = (t.as_py() or "").encode(), set()
                parse(raw, 0, 0, len(raw), phrases)
                out.append(fingerprint(phrases).hex())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.string())], [*keep, "fingerprint"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = "part int, first boolean, last boolean, text string"


def _row(doc_id, text: str, prints, following: str, next_print: bytes) -> tuple:
    new = edited(text, following)
    own, other = prints or both_fingerprints(text, new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, next_print)


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, compared with its edited text and the next document in id order.

    The texts are range-partitioned and sorted by id once. Within a partition each row meets the next one; the first and
    last rows of the partitions (two each) also bring their texts, and meet in a second step.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))  # short, as boundaries of ranges are held by the driver
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in (_OUT + ", " + _EDGE).split(", ")]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first, out = TaskContext.get().partitionId(), None, True, []

        def finish(held, follows):
            # held and follows are (doc_id, text). The next fingerprint is only known once that row is parsed, so rows
            # leave one step late: finished = edited result of held, still without near_next.
            return held[0], held[1], edited(held[1], follows[1])

        pending = None  # a row whose own values are known and whose near_next waits for the next fingerprint
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held is not None:
                    d0, t0, new = finish(held, (d, t))
                    own, other = both_fingerprints(t0, new)
                    if pending is not None:
                        out.append((*pending[0], likeness(pending[1], own), *pending[2]))
                    edge = (part, first, False, t0 if first else None)
                    pending = ((d0, len(t0), hashlib.sha256(new.encode()).hexdigest(), own.hex(), other.hex(), likeness(own, other)), own, edge)
                    first = False
                held = (d, t)
                if len(out) >= 500:
                    yield batch(out)
                    out = []
        if held is not None:
            whole: set[bytes] = set()
            raw = held[1].encode()
            parse(raw, 0, 0, len(raw), whole)
            own = fingerprint(whole)
            if pending is not None:
                out.append((*pending[0], likeness(pending[1], own), *pending[2]))
            out.append((held[0], len(held[1]), None, own.hex(), None, None, None, part, first, True, held[1]))
        if out:
            yield batch(out)

    done = materialize(ranged.mapInArrow(run, f"{_OUT}, {_EDGE}"), "fingerprints")
    edges = done.where("text is not null")
    # Each partition that has rows, with the next that has, the last with the first: one short row a partition.
    order = Window.orderBy("part")
    heads = edges.where("first").select("part")
    follows = heads.select(F.col("part").alias("of"), F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("then"))
    lasts = edges.where("last").join(follows, F.col("part") == F.col("of")).select("then", "doc_id", F.col("text").alias("own"))
    firsts = edges.where("first").select(F.col("part").alias("then"), F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_row(r["doc_id"], r["own"], None, r["following"], bytes.fromhex(r["next_print"])) for r in b.to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names[:7])

    closed = lasts.join(firsts, "then").select("doc_id", "own", "following", "next_print").mapInArrow(close, _OUT)
    return done.where("edited_sha256 is not null").select(names[:7]).unionByName(closed)
