"""Removal of word passages that occur earlier in the corpus, by automata of its recurring phrases.

A window is a number of consecutive words of a document. A word goes if a window that covers it also starts earlier: in a
document with a smaller id, or in the same one before. Steps:

1. One document stands for all with its text; the others are its copies.
2. Each window has an anchor: the phrase in it with the least hash. Equal windows have equal anchors, and some eight windows
   in a row share one, so few anchors are shuffled to find those that recur.
3. Windows with a recurring anchor are counted by hashes, and where each recurring one starts first is kept.
4. The stretches of documents around recurring anchors are dealt to shards by anchor. Each shard compiles an Aho-Corasick
   automaton of the windows that start there first, with words for letters, and streams all its stretches through it. What
   the automaton finds is equal word for word; hashes only choose what it looks for.
5. Each document drops the words of the windows found in it.

The stretches of an anchor that very many share are spread over all tasks, each of which has the anchor's windows in its
automaton. If those are many, too, the anchor is dealt by whole windows instead, and only a window that very many share is
spread. Such anchors and windows number 4096 each at most, whatever the size of the corpus. So no anchor or passage is a
large group of one task, and none is skipped.

Nulls: a null text has no words; null ids come last. Texts under one id are documents of their own, in the order of their
hashes; rows with one id and one text are one document and are judged alike. Fewer words than a window lose nothing. A
very long text is worked on whole, alone. Empty tables give no rows. No columns of docs but its id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm.components import hot_keys, join_spread
from tidegraph.llm.wordtable import Words, byte_strings, slices, split_blanks
from tidegraph.scratch import materialize

#: An anchor or window is very frequent if it has more than one of SHARES of all that recur (so at most as many are), and
#: more than BUSY.
SHARES, BUSY = 4096, 1000
#: Recurring windows of a very frequent anchor up to which all tasks get them.
FEW = 64
#: Recurring windows of a shard on average.
SHARD = 8192
ROWS = 1 << 15  # rows of a batch that a task gives back
PLACE = "z boolean, doc_id long, d long"  # a document in the order of ids: whether it has none, the id, the text's hash


@dataclass(frozen=True)
class Spec:
    """Words of a window and of the phrase that anchors it."""

    window: int = 20
    phrase: int = 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n successive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + h[i : len(h) - n + 1 + i]
    return _mix(out)


@dataclass
class Windows:
    """Of the documents of a stretch laid end to end: the words, the place where each window starts, its document and where
    its anchor is, and the phrases' hashes by place."""

    words: Words
    start: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    phrases: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, spec: Spec) -> Windows:
        w = split_blanks(texts, lower=False)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, w.table), np.uint64, len(w.table))[w.codes]
        many = np.maximum(w.sizes - spec.window + 1, 0)
        doc = np.repeat(np.arange(len(many)), many)
        start = np.repeat(w.starts - (np.cumsum(many) - many), many) + np.arange(len(doc))
        phrases = rolled(h, spec.phrase)
        at = start.copy()
        if len(start):
            least = phrases[start]
            for i in range(1, spec.window - spec.phrase + 1):
                here = phrases[start + i]
                less = here < least
                least = np.where(less, here, least)
                at[less] = start[less] + i
        return cls(w, start, doc, at, phrases, h)

    def tags(self, doc: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Anchors told apart by document."""
        return _mix(anchors ^ _mix(doc.astype(np.uint64) + np.uint64(1)))

    def among(self, given: list[np.ndarray]) -> np.ndarray:
        """Whether each window's anchor is one of those given for its document."""
        of = np.repeat(np.arange(len(given)), [len(g) for g in given])
        known = self.tags(of, np.concatenate([*given, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64))
        return np.isin(self.tags(self.doc, self.phrases[self.at]), known)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The numbers of each list, empty for null."""
    return [np.zeros(0, np.int64) if x.values is None else x.values.to_numpy() for x in column]


def _anchors(reps: DataFrame, spec: Spec) -> DataFrame:
    """(d, anchor, n): how often each phrase is an anchor of a document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, at = b.column("d").to_numpy(), 0
            for some in slices(b.column("raw")):
                w = Windows.of(some, spec)
                new = np.concatenate([[True], (w.at[1:] != w.at[:-1])])[: len(w.at)]
                doc, anchor = w.doc[new], w.phrases[w.at[new]]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])])[: len(doc)])
                n = np.diff(np.concatenate([first, [len(doc)]]))
                yield pa.record_batch({"d": d[at + doc[first]], "anchor": anchor[first].view(np.int64), "n": n.astype(np.int64)})
                at += len(some)

    return reps.select("d", "raw").mapInArrow(find, "d long, anchor long, n long")


def _windows(marked: DataFrame, spec: Spec) -> DataFrame:
    """(anchor, hash, z, doc_id, d, start) of each window whose anchor recurs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, anchors = 0, _lists(b.column("anchors"))
            for some in slices(b.column("raw")):
                w = Windows.of(some, spec)
                ok = w.among(anchors[at : at + len(some)])
                of = pa.array(at + w.doc[ok])
                whole = rolled(w.hashes, spec.window)[w.start[ok]] if ok.any() else np.zeros(0, np.uint64)
                start = w.start[ok] - w.words.starts[w.doc[ok]]
                yield pa.record_batch({"anchor": w.phrases[w.at[ok]].view(np.int64), "hash": whole.view(np.int64), **{c: b.column(c).take(of) for c in ("z", "doc_id", "d")}, "start": start.astype(np.int32)})
                at += len(some)

    return marked.select("z", "doc_id", "d", "raw", "anchors").mapInArrow(find, f"anchor long, hash long, {PLACE}, start int")


def _stretches(docs: DataFrame, spec: Spec, shards: int, parts: int, spread: np.ndarray, split: np.ndarray, busy: frozenset[int]) -> DataFrame:
    """docs(z, doc_id, d, raw, anchors, firsts) to (shard, kind, z, doc_id, d, lo, body, firsts). Kind 0: words of a document
    from lo on, and the places in them where windows start first. Kind 1: words in which other windows start. Anchors of spread go to all tasks, those of split
    by windows, of which the ones in busy go to all tasks."""
    n = spec.window
    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("z", pa.bool_()), ("doc_id", pa.int64()), ("d", pa.int64()), ("lo", pa.int32()), ("body", pa.binary()), ("firsts", pa.list_(pa.int32()))])

    def shard_of(key: int, salt: int) -> int:
        return xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True), salt) % shards

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for b in batches:
            at, anchors, firsts = 0, _lists(b.column("anchors")), _lists(b.column("firsts"))
            z, ids, d = (b.column(c).to_pylist() for c in ("z", "doc_id", "d"))
            for some in slices(b.column("raw")):
                w = Windows.of(some, spec)
                ok = np.flatnonzero(w.among(anchors[at : at + len(some)]))
                starts = w.words.starts
                first = np.zeros(len(w.hashes) + 1, bool)
                for i, f in enumerate(firsts[at : at + len(some)]):
                    first[starts[i] + f] = True
                start, place, doc = w.start[ok], w.at[ok], w.doc[ok]
                anchor = w.phrases[place].view(np.int64)
                alone, wide = np.isin(anchor, split), np.isin(anchor, spread)
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | alone[1:]])[: len(place)]
                lo = np.flatnonzero(new)
                hi = np.concatenate([lo[1:], [len(place)]])[: len(lo)]
                whole = rolled(w.hashes, n).view(np.int64) if len(lo) else place
                table, codes = w.words.table, w.words.codes
                for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                    a, e, i = int(start[x]), int(start[y - 1]), int(doc[x])
                    own = first[a : e + 1]
                    key = int(whole[a]) if alone[x] else int(anchor[x])
                    everywhere = wide[x] or (alone[x] and key in busy)
                    body = b" ".join([table[c] for c in codes[a : e + n].tolist()])
                    row = (z[at + i], ids[at + i], d[at + i], a - int(starts[i]), body)
                    if own.any():
                        rel = np.flatnonzero(own).tolist()
                        rows.extend((shard_of(key, s), 0, *row, rel) for s in range(parts if everywhere else 1))
                    if not own.all():
                        rows.append((shard_of(key, d[at + i] % parts if everywhere else 0), 1, *row, []))
                    if len(rows) >= ROWS:
                        yield sent()
                at += len(some)
        if rows:
            yield sent()

    return docs.select("z", "doc_id", "d", "raw", "anchors", "firsts").mapInArrow(cut, f"shard int, kind int, {PLACE}, lo int, body binary, firsts array<int>")


def _located(stretches: DataFrame, spec: Spec, parts: int) -> DataFrame:
    """stretches of documents to (z, doc_id, d, lo, hi): words of windows that start earlier elsewhere, stretch by stretch."""
    n = spec.window
    schema = pa.schema([("z", pa.bool_()), ("doc_id", pa.int64()), ("d", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ready = None, False
        letters: dict[bytes, str] = {}
        automaton = ahocorasick.Automaton()
        out: list[tuple] = []

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made

        def letter(word: bytes) -> str:
            """A code point for each word of the shard's patterns; 0 is for all others, surrogates are left out."""
            if (c := letters.get(word)) is None:
                i = len(letters) + 1
                c = letters[word] = chr(i if i < 0xD800 else i + 0x800)
            return c

        for b in batches:
            shards, kinds, los, own = b.column("shard").to_pylist(), b.column("kind").to_pylist(), b.column("lo").to_pylist(), [b.column(c).to_pylist() for c in ("z", "doc_id", "d")]
            bodies, firsts = byte_strings(b.column("body")), b.column("firsts").to_pylist()
            for i, (s, kind, lo, body) in enumerate(zip(shards, kinds, los, bodies, strict=True)):
                if s != shard:
                    shard, ready, letters, automaton = s, False, {}, ahocorasick.Automaton()
                words, place = body.split(b" "), (own[0][i], own[1][i], own[2][i])
                if kind == 0:
                    text = "".join(map(letter, words))
                    for rel in firsts[i]:
                        automaton.add_word(text[rel : rel + n], (*place, lo + rel))
                    continue
                if not len(automaton):
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                text, last = "".join([letters.get(w, "\0") for w in words]), None
                for end, first in automaton.iter(text):
                    start = lo + end - n + 1
                    if first == (*place, start):
                        continue
                    if last is not None and start <= last[1]:
                        last[1] = start + n
                    else:
                        if last is not None:
                            out.append((*place, *last))
                        last = [start, start + n]
                if last is not None:
                    out.append((*place, *last))
                if len(out) >= ROWS:
                    yield sent()
        if out:
            yield sent()

    sorted_ = stretches.repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    return sorted_.mapInArrow(stream, f"{PLACE}, lo int, hi int")


def _dropped(rows: DataFrame, spec: Spec) -> DataFrame:
    """rows(doc_id, raw, copy, ranges) to (doc_id, n_words, n_removed, kept)."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, copy = 0, b.column("copy").to_numpy(zero_copy_only=False)
            los, his = (_lists(b.column(c)) for c in ("los", "his"))
            for some in slices(b.column("raw")):
                w = split_blanks(some, lower=False)
                total, starts = len(w.codes), w.starts
                edge = np.zeros(total + 1, np.int64)
                for i in range(len(some)):
                    if copy[at + i]:
                        if w.sizes[i] >= spec.window:
                            edge[starts[i]] += 1
                            edge[starts[i] + w.sizes[i]] -= 1
                    elif len(los[at + i]):
                        np.add.at(edge, starts[i] + los[at + i], 1)
                        np.add.at(edge, starts[i] + his[at + i], -1)
                keep = np.cumsum(edge[:total]) == 0
                words = [w.table[c] for c in w.codes[keep].tolist()]
                cuts = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([starts[:1], w.ends])]
                texts = [b" ".join(words[x:y]) for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(at, len(some)), "n_words": pa.array(w.sizes, pa.int64()), "n_removed": pa.array(w.sizes - np.diff(cuts), pa.int64()), "kept": pa.array(texts, pa.binary())})
                at += len(some)

    return rows.select("doc_id", "raw", "copy", F.col("ranges.lo").alias("los"), F.col("ranges.hi").alias("his")).mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of docs(doc_id, text): kept is the text of the words that stay, joined
    by one space."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").isNull().alias("z"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    keyed = keyed.withColumn("t", F.unhex(F.md5("raw")))
    reps = keyed.groupBy("t").agg(F.min(F.struct("z", "doc_id")).alias("first"), F.first("raw").alias("raw"), F.count("*").alias("n"))
    reps = materialize(reps.select("t", F.xxhash64("t").alias("d"), "first.z", "first.doc_id", "raw", "n"), "texts")

    every = F.sum("n").over(Window.partitionBy("anchor"))
    anchors = materialize(_anchors(reps, spec).withColumn("all", every).where("all > 1"), "anchors")
    total = anchors.agg(F.sum("n")).first()[0] or 0
    limit = max(BUSY, total // SHARES)

    given = anchors.groupBy("d").agg(F.collect_list("anchor").alias("anchors"))
    marked = materialize(reps.select("z", "doc_id", "d", "raw").join(given, "d").select("z", "doc_id", "d", "raw", "anchors"), "marked")
    place = F.struct("z", "doc_id", "d", "start")
    known = _windows(marked, spec).groupBy("anchor", "hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Of anchors and windows only the very frequent ones are looked at again.
    frequent = [r[0] for r in anchors.where(F.col("all") > limit).select("anchor").distinct().collect()]
    known = materialize(known.select(F.when(F.col("anchor").isin(frequent), F.col("anchor")).alias("anchor"), F.when(F.col("n") > limit, F.col("hash")).alias("hash"), "first"), "windows")
    few = {r.anchor: r["count"] <= FEW for r in known.where("anchor is not null").groupBy("anchor").count().collect()}
    spread, split = (np.array([k for k in frequent if few.get(k, True) == x], np.int64) for x in (True, False))
    busy = frozenset(r[0] for r in known.where("hash is not null").select("hash").collect())
    shards = max(parts, known.count() // SHARD)

    firsts = known.groupBy("first.z", "first.doc_id", "first.d").agg(F.collect_list("first.start").alias("firsts"))
    found = _located(_stretches(marked.join(firsts, ["z", "doc_id", "d"], "left"), spec, shards, parts, spread, split, busy), spec, parts)
    ranges = found.groupBy("z", "doc_id", "d").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    of_text = reps.select("t", "d", "z", "doc_id").join(ranges, ["z", "doc_id", "d"], "left").select("t", F.col("z").alias("own_z"), F.col("doc_id").alias("own_id"), "ranges")
    hot = hot_keys(reps.select("t", "n"), "t", reps.agg(F.sum("n")).first()[0] or 0)
    rows = join_spread(keyed.withColumn("spread", F.monotonically_increasing_id()), of_text, "t", "spread", hot)
    copy = (F.col("z") != F.col("own_z")) | (F.col("doc_id") != F.col("own_id"))
    rows = rows.select(F.when(~F.col("z"), F.col("doc_id")).alias("doc_id"), "raw", copy.alias("copy"), "ranges")
    return _dropped(rows, spec).select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


#: DuckDB SQL for the digest of remove_repeats() over documents.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
x AS (SELECT doc_id, i, array_to_string(t[i + 1 : i + 20], ' ') AS s FROM (SELECT doc_id, t, unnest(range(0, len(t) - 19)) AS i FROM w WHERE len(t) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, len(t) AS n, t, unnest(range(0, len(t))) AS j FROM w),
kept AS (SELECT a.doc_id, string_agg(a.t[a.j + 1], ' ' ORDER BY a.j) AS text, count(*) AS n FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.j = g.j WHERE g.j IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.t) AS BIGINT) AS n_words, CAST(len(w.t) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
