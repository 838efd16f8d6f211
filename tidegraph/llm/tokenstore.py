"""Token ids in a content-addressed binary store.

Every text is encoded, closed with an end id, and its id stream cut where a rolling hash of the last ids says so; equal
passages therefore give equal chunks wherever they stand. A store is a folder with four tables:

chunks    address (BLAKE2b of the payload), n ids, payload: ids as little-endian unsigned integers of the store's width
recipes   part, seq, doc_id, local_start, n_tokens, addresses, leaf: the documents in ascending id order, ties by content
offsets   part, start, n_docs, n_tokens: ids before each part of the recipes
manifest  width, n_docs, n_tokens, root: the Merkle root over the leaves of all recipes

Each unique chunk is stored once. Reading checks every payload against its address, every recipe against its leaf, the
leaves against the root, and that the chunks of a document have its number of ids.

Nulls: a null text is empty and has the end id only; null ids come first. Repeated rows are documents of their own. An
empty table gives an empty store.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm.bpe import BYTES, tokenizer
from tidegraph.llm.wordtable import gather, slices, split_blanks
from tidegraph.scratch import materialize

#: Ids that the rolling hash sees, mean distance of cuts, and bounds of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 4096
FANOUT = 256
#: Words that a generation of the cache holds.
MEMORY = 600_000
#: The punctuation marks of ASCII.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_caches: dict[str, WordCache] = {}


class WordCache:
    """Ids of words, for a tokenizer that drops white space, never joins words, lower-cases, and ends each run of letters
    with one id of its own kind. Two generations: the words used lately outlive a full cache."""

    def __init__(self, path: str):
        self.tokenizer, self.young, self.old = tokenizer(path), {}, {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only. Those that normalizing and splitting leave as they are come straight from the
        vocabulary's merges; others are encoded many at a time and cut apart after each ending id."""
        merge = self.tokenizer.model.tokenize
        plain = [w.islower() if w.isascii() else w == w.lower() and unicodedata.is_normalized("NFC", w) for w in words]
        others = iter(self._joined([w for w, p in zip(words, plain, strict=True) if not p]))
        return [array("I", [t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(BYTES))]).tobytes() if p else next(others) for w, p in zip(words, plain, strict=True)]

    def _joined(self, words: list[str]) -> list[bytes]:
        lots = [words[i : i + 100] for i in range(0, len(words), 100)]
        out: list[bytes] = []
        for lot, ids in zip(lots, self._encode([" ".join(x) for x in lots]), strict=True):
            at = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(at) == len(lot):
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *at], at, strict=False)]
            else:  # a letter that its lower case takes apart
                out += [x.tobytes() for x in self._encode(lot)]
        return out

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of any words: encoded many at a time with a word between them that has an id of its own."""
        between = self._encode(["between"])[0]
        lots = [words[i : i + 100] for i in range(0, len(words), 100)]
        out: list[bytes] = []
        for lot, ids in zip(lots, self._encode([" between ".join(x) for x in lots]), strict=True):
            at = np.flatnonzero(ids == between[0]).tolist()
            if len(between) == 1 and len(at) == len(lot) - 1:
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in at)], [*at, len(ids)], strict=True)]
            else:  # one of the words holds it
                out += [x.tobytes() for x in self._encode(lot)]
        return out

    def _learn(self, words: set[bytes]) -> None:
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        bodies: dict[bytes, str] = {}  # of letters; marks behind them are taken apart by the tokenizer too
        marked, odd = [], {}
        for w in words:
            if (x := old.get(w)) is not None:
                young[w] = x
                continue
            body = w.rstrip(MARKS)
            text = body.decode("utf-8", "replace")
            if not text.isalpha() or not (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha()):
                odd[w] = None  # the tokenizer may see other marks in it, and keep those behind it together with them
                continue
            if body not in young:
                if (x := old.get(body)) is not None:
                    young[body] = x
                else:
                    bodies[body] = text
            if len(body) < len(w):
                marked.append(w)
                if (mark := w[len(body) :]) not in young:
                    odd[mark] = None
        young.update(zip(bodies, self._letters(list(bodies.values())), strict=True))
        young.update(zip(odd, self._others([w.decode("utf-8", "replace") for w in odd]), strict=True))
        for w in marked:
            body = w.rstrip(MARKS)
            young[w] = young[body] + young[w[len(body) :]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Lower-casing A-Z beforehand changes nothing but the names of special tokens, so texts
        that might hold one are left as they are."""
        special = np.asarray(pc.match_substring(texts.view(pa.string()), "<|"))
        out: list[np.ndarray] = [None] * len(texts)
        for lower in (True, False):
            at = np.flatnonzero(special != lower)
            if not len(at):
                continue
            w = split_blanks(texts.take(pa.array(at)), lower)
            ids = list(map(self.young.get, w.table))
            while new := {x for x, i in zip(w.table, ids, strict=True) if i is None}:
                self._learn(new)  # may start a new generation, which need not have the words found before
                ids = [i if i is not None else self.young.get(x) for x, i in zip(w.table, ids, strict=True)]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
            sizes = size[w.codes]
            flat, cut = gather(flat, start[w.codes], sizes), np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], w.ends])].tolist()
            for i, a, b in zip(at.tolist(), cut, cut[1:], strict=False):
                out[i] = flat[a:b]
        return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    step = 1
    while step < WINDOW:  # a sum of shifted values over the window, doubled at each turn
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    out, last = [], 0
    for c in (np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1).tolist() + [len(ids)]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or (c == len(ids) and c > last):
            out.append(c)
            last = c
    return out


def address(payload: bytes) -> bytes:
    return blake2b(payload, digest_size=20).digest()


def leaf(doc_id: int | None, n_tokens: int, addresses: list[bytes]) -> bytes:
    return sha256(f"{doc_id}:{n_tokens}:".encode() + b"".join(addresses)).digest()


def merkle_root(leaves: DataFrame) -> bytes:
    """Root over leaves(part, seq, leaf): hashes of FANOUT children at a time, within the parts, then over the parts."""

    def up(level: DataFrame, *keys: str) -> DataFrame:
        at = F.floor(F.col("seq") / FANOUT).cast("long").alias("seq")
        children = F.transform(F.array_sort(F.collect_list(F.struct("seq", "leaf"))), lambda x: F.hex(x.leaf))
        return level.groupBy(*keys, at).agg(F.unhex(F.sha2(F.array_join(children, ","), 256)).alias("leaf"))

    level, last = leaves, leaves.agg(F.max("seq")).first()[0]
    if last is None:
        return sha256(b"").digest()
    while last > 0:
        level, last = up(level, "part"), last // FANOUT
    level = level.select(F.col("part").cast("long").alias("seq"), "leaf")
    last = level.agg(F.max("seq")).first()[0]
    while True:
        level, last = up(level), last // FANOUT
        if last == 0:
            return bytes(level.first().leaf)


def write_store(docs: DataFrame, path: str, store: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    width = 2 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dtype = f"<u{width}"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _caches:
            _caches[path] = WordCache(path)
        cache, sent = _caches[path], set()
        piece = pa.struct([("address", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])
        for b in batches:
            done = 0
            for part in slices(b.column("raw")):
                n, names, fresh = [], [], []
                for own_ids in cache.encode(part):
                    ids = np.append(own_ids, np.uint32(end_id))
                    small, last, own, new = ids.astype(dtype), 0, [], []
                    for c in cuts(ids):
                        payload = small[last:c].tobytes()
                        a = address(payload)
                        own.append(a)
                        if a not in sent:  # the shuffle drops what other tasks send too
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(a)
                            new.append({"address": a, "n": c - last, "payload": payload})
                        last = c
                    n.append(len(ids))
                    names.append(own)
                    fresh.append(new)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(part)), pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(fresh, pa.list_(piece))], ["doc_id", "n_tokens", "addresses", "fresh"])
                done += len(part)

    encoded = materialize(texts.mapInArrow(cut, "doc_id long, n_tokens long, addresses array<binary>, fresh array<struct<address:binary,n:int,payload:binary>>"), "encoded")
    chunks = encoded.select(F.inline("fresh")).groupBy("address").agg(F.first(F.struct("n", "payload")).alias("c")).select("address", "c.n", "c.payload")
    chunks.write.option("compression", "zstd").parquet(f"{store}/chunks")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            starts, leaves = [], []
            for r in b.to_pylist():
                starts.append(start)
                start += r["n_tokens"]
                leaves.append(leaf(r["doc_id"], r["n_tokens"], r["addresses"]))
            seqs = pa.array(range(seq, seq + len(b)), pa.int64())
            seq += len(b)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(b), pa.int32()), seqs, b.column("doc_id"), pa.array(starts, pa.int64()), b.column("n_tokens"), b.column("addresses"), pa.array(leaves, pa.binary())], ["part", "seq", "doc_id", "local_start", "n_tokens", "addresses", "leaf"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.element_at("addresses", 1)
    ranged = encoded.select("doc_id", "n_tokens", "addresses").repartitionByRange(parts, "doc_id", first).sortWithinPartitions("doc_id", "addresses")
    ranged.mapInArrow(number, "part int, seq long, doc_id long, local_start long, n_tokens long, addresses array<binary>, leaf binary").write.option("compression", "zstd").parquet(f"{store}/recipes")

    recipes = spark.read.parquet(f"{store}/recipes")
    sums = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_docs", "n_tokens").write.parquet(f"{store}/offsets")
    root = merkle_root(recipes.select("part", "seq", "leaf"))
    offsets = spark.read.parquet(f"{store}/offsets")
    offsets.agg(F.lit(width).alias("width"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.lit(root).alias("root")).write.parquet(f"{store}/manifest")


def _manifest(spark: SparkSession, store: str):
    m = spark.read.parquet(f"{store}/manifest").first()
    recipes = spark.read.parquet(f"{store}/recipes")
    if merkle_root(recipes.select("part", "seq", "leaf")) != bytes(m.root):
        raise ValueError(f"{store}: the recipes do not match the Merkle root")
    return m, recipes


def _references(recipes: DataFrame) -> DataFrame:
    """(part, seq, pos, address), after a check of each recipe against its leaf."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if leaf(r["doc_id"], r["n_tokens"], r["addresses"]) != r["leaf"]:
                    raise ValueError(f"recipe {r['doc_id']} does not match its leaf")
            yield b.select(["part", "seq", "addresses"])

    return recipes.mapInArrow(check, "part int, seq long, addresses array<binary>").select("part", "seq", F.posexplode("addresses").alias("pos", "address"))


def _crc_shift(n: int, made: dict[int, list[int]] = {}) -> list[int]:  # noqa: B006
    """Images of the 32 bits of a CRC-32 under n zero bytes: appending bytes is linear in what went before."""
    if n not in made:
        zero = bytes(n)
        made[n] = [zlib.crc32(zero, 1 << i) ^ zlib.crc32(zero, 0) for i in range(32)]
    return made[n]


def crc_join(a: int, b: int, n: int) -> int:
    """CRC-32 of two byte strings end to end, from theirs and the second one's length."""
    for i, image in enumerate(_crc_shift(n)):
        if a >> i & 1:
            b ^= image
    return b


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. CRCs of the chunks are joined along the
    recipes, so payloads don't travel."""
    m, recipes = _manifest(spark, store)
    width = m.width

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = []
            for a, n, p in zip(*(b.column(c).to_pylist() for c in ("address", "n", "payload")), strict=True):
                if address(p) != a or len(p) != n * width:
                    raise ValueError("a chunk does not match its address")
                crc.append(zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()))
            yield pa.record_batch({"address": b.column("address"), "n": b.column("n"), "crc": pa.array(crc, pa.int64())})

    chunks = spark.read.parquet(f"{store}/chunks").select("address", "n", "payload").mapInArrow(digest, "address binary, n int, crc long")

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            own = b.column("own")
            flat, ends = own.flatten(), np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(own), 0)))
            crcs, sizes, at = flat.field("crc").to_pylist(), flat.field("n").to_pylist(), 0
            for whole, end in zip(b.column("n_tokens").to_pylist(), ends.tolist(), strict=True):
                crc, n = (crcs[at], sizes[at]) if end > at else (0, 0)
                for i in range(at + 1, end):
                    crc, n = crc_join(crc, crcs[i], 4 * sizes[i]), n + sizes[i]
                if n != whole:
                    raise ValueError("a document's chunks do not add up")
                out.append(crc)
                at = end
            yield pa.record_batch({"doc_id": b.column("doc_id"), "start": b.column("start"), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(out, pa.int64())})

    found = _references(recipes).join(chunks, "address").groupBy("part", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("own"))
    offsets = F.broadcast(spark.read.parquet(f"{store}/offsets").select("part", F.col("start").alias("before")))  # a row for each part
    rows = recipes.select("part", "seq", "doc_id", "local_start", "n_tokens").join(offsets, "part").join(found, ["part", "seq"], "left")
    return rows.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "own").mapInArrow(along, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, n_tokens, ids binary of 32 bits each): the documents put together again."""
    m, recipes = _manifest(spark, store)
    width = m.width
    chunks = spark.read.parquet(f"{store}/chunks").select("address", "payload")
    found = _references(recipes).join(chunks, "address").groupBy("part", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "address", "payload"))).alias("own"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for whole, own in zip(b.column("n_tokens").to_pylist(), b.column("own").to_pylist(), strict=True):
                if any(address(x["payload"]) != x["address"] for x in own or ()):
                    raise ValueError("a chunk does not match its address")
                ids = np.frombuffer(b"".join(x["payload"] for x in own or ()), f"<u{width}").astype("<u4")
                if len(ids) != whole:
                    raise ValueError("a document's chunks do not add up")
                out.append(ids.tobytes())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": b.column("n_tokens"), "ids": pa.array(out, pa.binary())})

    rows = recipes.select("part", "seq", "doc_id", "n_tokens").join(found, ["part", "seq"], "left")
    return rows.select("doc_id", "n_tokens", "own").mapInArrow(build, "doc_id long, n_tokens long, ids binary")
