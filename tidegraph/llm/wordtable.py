"""Distinct-word tables of a corpus, by chunks of texts and buckets of words.

Each task cuts its rows into chunks of bounded size and splits the texts of a chunk once: into the distinct words and a
number for each occurrence. A chunk asks for each of its distinct words at the bucket of the word's hash. A bucket meets
every distinct word once, however many chunks ask for it, works out what is wanted and answers each chunk in the order of
its questions; the answers go back to the chunk. So a word is never hot: a chunk asks for it once. A word over LONG bytes is
asked for by a mark, 128 bits of hash, and its bytes reach the bucket once, whatever the number of chunks that hold it.
Nothing goes to the driver or to all tasks, a task holds one chunk or one bucket, and the number of buckets follows the size
of the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.scratch import MOST_BUCKETS, in_buckets

#: Bytes of text in a chunk, and for each bucket.
CHUNK, SHARE = 16 << 20, 16 << 20
#: Bytes of a word that may be sent by every chunk that holds it.
LONG = 256
LEVEL = 3  # of the compression of what is shuffled
SLICE = 8 << 20  # bytes of text that are split at a time; a longer text is split alone


@dataclass
class Words:
    """The words of some texts: the distinct ones, the number of each occurrence in order, how many each text has."""

    table: list[bytes]
    codes: np.ndarray
    sizes: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)

    @property
    def starts(self) -> np.ndarray:
        return self.ends - self.sizes


def slices(column: pa.Array, stretch: int = SLICE) -> Iterator[pa.Array]:
    """Stretches of about as many bytes of a binary column without nulls."""
    size = np.cumsum(np.asarray(pc.binary_length(column)), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(size // stretch)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(column)], strict=True):
        if a < b:
            yield column.slice(a, b - a)


def byte_strings(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column without nulls."""
    if not len(column):
        return []
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset).tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def numbered(words: pa.Array, sizes: np.ndarray) -> Words:
    coded = words.dictionary_encode()
    return Words(byte_strings(coded.dictionary), coded.indices.to_numpy(), sizes)


def split_blanks(texts: pa.Array, lower: bool = True) -> Words:
    """Words between the six ASCII white-space characters, with A-Z lower-cased."""
    plain = texts.view(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain) if lower else plain)
    words, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    full = np.asarray(pc.binary_length(words)) > 0  # outer white space leaves empty words
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        sizes = np.diff(before[np.concatenate([[0], np.cumsum(sizes)])])
        words = words.filter(pa.array(full))
    return numbered(words, sizes)


def give_back() -> None:
    """Returns to the system what a worker has freed: executors count what their idle workers hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


# -- numbers and words as bytes


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] to start[i] + size[i] end to end."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches flat[start[i] : start[i] + size[i]] end to end."""
    return flat[spans(start, size)]


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, ..., compressed."""
    return zstandard.compress(values.view("u1").reshape(len(values), values.itemsize).T.tobytes(), LEVEL)


def from_planes(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), "u1")
    return raw.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def pack(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.compress(sizes.tobytes() + b"".join(words), LEVEL)


def unpack(blob: bytes, n: int) -> pa.Array:
    raw = zstandard.decompress(blob)
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 * n :])])


def mark(word: bytes) -> bytes:
    """What stands for a long word; no UTF-8 text holds it."""
    return b"\xff" + xxhash.xxh3_128_digest(word)


# -- chunks and buckets


def bucket_count(rows: DataFrame, column: str = "raw") -> int:
    """Buckets for a corpus: one for every SHARE bytes, and at least as many as shuffles have partitions."""
    size = rows.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))


def chunk_table(rows: DataFrame, split: Callable[[pa.Array], tuple[np.ndarray | None, Words]], buckets: int, weigh: str | None = None, most: int | None = None, brings: bool = False) -> DataFrame:
    """rows(..., raw binary without nulls) to one written row for each chunk of texts:

    chunk, an array of each other column of rows, sizes (words of each text), codes (number of each word), places (number
    of each word asked for, in the order of the questions), requests(bucket, n, words, counts), long(bucket, mark, words).

    split gives the words of some texts, and the order in which it has put the texts if it isn't theirs. weigh: a boolean
    column; counts then has how often each word occurs in the chunk's rows where it is true. most: bytes of text in a
    chunk; a longer text is a chunk of its own. brings: whether long has the long words; else only their marks are known."""
    most, longest = most or CHUNK, LONG
    keep = [c for c in rows.columns if c != "raw"]
    types = {c: rows.schema[c].dataType.simpleString() for c in keep}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            cols = {c: pa.concat_arrays([h.column(c) for h in held]) for c in [*keep, "raw"]}
            held.clear()
            order, w = split(cols.pop("raw"))
            if order is not None:
                cols = {c: v.take(pa.array(order)) for c, v in cols.items()}
            n = len(w.table)
            weight = np.repeat(cols[weigh].to_numpy(zero_copy_only=False), w.sizes) if weigh else None
            counts = np.bincount(w.codes[weight], minlength=n).astype("<u8") if weigh else None
            by = np.argsort(-np.bincount(w.codes, minlength=n), kind="stable")  # small numbers for frequent words
            rank = np.empty(n, np.int64)
            rank[by] = np.arange(n)
            marks = [x if len(x) <= longest else mark(x) for x in w.table]
            bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, marks), np.uint64, n) % np.uint64(buckets)).astype(np.int32)
            long = [{"bucket": int(bucket[i]), "mark": marks[i], "words": pack([x])} for i, x in enumerate(w.table) if brings and len(x) > longest]
            asked = pc.sort_indices(pa.table({"b": bucket, "w": pa.array(marks, pa.binary())}), sort_keys=[("b", "ascending"), ("w", "ascending")]).to_numpy().astype(np.int64)
            own, first = np.unique(bucket[asked], return_index=True)
            requests = [{"bucket": b, "n": e - a, "words": pack([marks[i] for i in asked[a:e].tolist()]), "counts": planes(counts[asked[a:e]]) if weigh else b""} for b, a, e in zip(own.tolist(), first.tolist(), np.append(first[1:], n)[: len(own)].tolist(), strict=True)]
            out = {"chunk": pa.array([part << 32 | seq], pa.int64())}
            out |= {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in cols.items()}
            out["sizes"] = pa.array([w.sizes], pa.list_(pa.int64()))
            out["codes"] = pa.array([planes(rank[w.codes].astype("<u4"))], pa.binary())
            out["places"] = pa.array([planes(rank[asked].astype("<u4"))], pa.binary())
            out["requests"] = pa.array([requests], pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])))
            out["long"] = pa.array([long], pa.list_(pa.struct([("bucket", pa.int32()), ("mark", pa.binary()), ("words", pa.binary())])))
            return pa.record_batch(out)

        for b in batches:
            sizes, at = np.asarray(pc.binary_length(b.column("raw"))).astype(np.int64) + 16, 0
            while at < len(b):
                sums = np.cumsum(sizes[at:])
                n = min(int(np.searchsorted(sums, most - size)) + 1, len(b) - at)
                held.append(b.slice(at, n))
                size, at = size + int(sums[n - 1]), at + n
                if size >= most:
                    yield made()
                    size, seq = 0, seq + 1
                    give_back()
        if held:
            yield made()
        give_back()

    schema = "chunk long, " + "".join(f"`{c}` array<{types[c]}>, " for c in keep) + "sizes array<long>, codes binary, places binary, requests array<struct<bucket:int,n:int,words:binary,counts:binary>>, long array<struct<bucket:int,mark:binary,words:binary>>"
    return in_buckets(rows.select(*keep, "raw").mapInArrow(cut, schema), "chunk", buckets, "chunks")


def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of sorted batches in runs of equal values of the columns names."""
    key, held = None, []
    for r in rows_of(batches):
        k = tuple(r[n] for n in names)
        if held and k != key:
            yield key, held
            held = []
        key = k
        held.append(r)
    if held:
        yield key, held


def to_buckets(rows: DataFrame, buckets: int, *order: str) -> DataFrame:
    """rows(bucket, ...) with each bucket's rows in one task, one after the other, sorted by the columns order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(buckets, max(parts, buckets // 4))
    return rows.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket", *order)


def requests(table: DataFrame) -> DataFrame:
    """(chunk, bucket, n, words, counts) of each request. Those of chunk -1 ask for nothing: they bring a long word each."""
    asked = table.select("chunk", F.inline("requests"))
    long = table.select(F.inline("long")).groupBy("bucket", "mark").agg(F.first("words").alias("words"))
    brought = long.select(F.lit(-1).cast("long").alias("chunk"), "bucket", F.lit(1).alias("n"), "words", F.lit(b"").alias("counts"))
    return asked.unionByName(brought)


def without_long(rows: list[dict]) -> tuple[list[dict], dict[bytes, bytes]]:
    """The requests of one bucket that ask, and the long words by their marks."""
    brought = [unpack(r["words"], 1)[0].as_py() for r in rows if r["chunk"] < 0]
    return [r for r in rows if r["chunk"] >= 0], {mark(w): w for w in brought}


def asked_words(rows: list[dict]) -> tuple[pa.Array, np.ndarray, list[int]]:
    """Of the requests of one bucket: the distinct words or marks, the number of each one asked for, where each request ends."""
    words = pa.concat_arrays([unpack(r["words"], r["n"]).cast(pa.large_binary()) for r in rows]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.cumsum([r["n"] for r in rows]).tolist()


def with_answers(table: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """The rows of chunk_table() without what they ask, each with answers: an array of the (kind, bucket, body) that
    answers(chunk, kind, bucket, body) has for it, by kind and bucket. Only the answers travel, once, to the buckets in which the table lies."""
    per_chunk = answers.repartition(min(buckets, MOST_BUCKETS), "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("kind", "bucket", "body"))).alias("answers"))
    return table.drop("requests", "long").join(per_chunk.hint("shuffle_hash"), "chunk", "left")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time."""
    for b in batches:
        for i in range(len(b)):
            yield {c: v[i].as_py() for c, v in zip(b.schema.names, b.columns, strict=True)}
