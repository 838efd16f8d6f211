"""BPE encoding and decoding through a table of distinct words.

A text is cut at every single space between two characters that are no white space; there the tokenizer's own splitting
starts a new piece, so the ids of a text are the ids of its words, one after the other. Each distinct word of the corpus
is encoded once, in the bucket of its hash, and its ids are joined back to the positions where it stands, by chunks of
texts (see wordtable). Decoding joins ids with the vocabulary's pieces.

Nulls: a null text is empty; null ids and repeated rows keep their rows. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.wordtable import Words, asked_words, bucket_count, chunk_table, from_planes, gather, give_back, numbered, planes, requests, rows_of, runs, slices, to_buckets, with_answers, without_long

#: Where a text may be cut: at a single space between two characters that are no white space (for Python, whose white
#: space includes the tokenizer's).
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The white space of ASCII but the space, and the first bytes that other white space has in UTF-8.
_ASCII_SPACE = [bytes([i]) for i in (*range(9, 14), *range(28, 32))]
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves.
BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
SPACE = chr(BYTES[32])
_OTHER_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Words that are encoded in one go, texts that are looked at together, words of documents that are made at a time.
LOT, TOGETHER, TOGETHER_WORDS = 100, 64, 1 << 19
TOGETHER_BYTES = 4 << 20  # of ids that are decoded at a time
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, once for each Python worker, without truncation and padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def _plain(raw: bytes) -> bool:
    """Whether every space of a text is a place to cut."""
    if raw[:1] == b" " or raw[-1:] == b" " or b"  " in raw or any(x in raw for x in _OTHER_SPACE):
        return False
    return not any(x in raw and (x + b" " in raw or b" " + x in raw) for x in _ASCII_SPACE)


def _surely_plain(raw: bytes) -> bool:
    """Whether no space has white space or another control character beside it, and there is no space but those of ASCII."""
    byte = np.frombuffer(raw, "u1")
    space, low = byte == 32, byte <= 32
    if (space[1:] & low[:-1]).any() or (low[1:] & space[:-1]).any():
        return False
    return not any(x[:1] in raw and x in raw for x in _OTHER_SPACE)


def _odd(texts: pa.Array) -> list[int]:
    """The texts that are not plain. Looks at all of them end to end first, by stretches, as few have anything odd."""
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int32, len(texts) + 1, 4 * texts.offset)
    flat, out = memoryview(data or b""), []
    cuts = [*range(0, len(texts), TOGETHER), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        raw = bytes(flat[at[a] : at[b]])
        if not _surely_plain(raw):
            out += [i for i in range(a, b) if not _plain(raw[at[i] - at[a] : at[i + 1] - at[a]])]
            continue
        size = np.diff(at[a : b + 1])
        byte, some = np.frombuffer(raw, "u1"), np.flatnonzero(size)
        start = at[a:b][some] - at[a]
        out += (a + some[(byte[start] == 32) | (byte[start + size[some] - 1] == 32)]).tolist()
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, Words]:
    """An order of the texts, and their words in that order. All words but the first of a text have lost the space before
    them; the first gets one to tell it apart."""
    odd = _odd(texts)
    plain = np.setdiff1d(np.arange(len(texts)), odd)
    lists = pc.split_pattern(texts.take(pa.array(plain)).view(pa.string()), " ")
    more = [[p.encode() for p in _CUT.split(texts[i].as_py().decode("utf-8", "replace"))] for i in odd]
    words = pa.concat_arrays([lists.flatten().view(pa.binary()), pa.array([p for x in more for p in x], pa.binary())])
    sizes = np.concatenate([np.asarray(pc.list_value_length(lists)), [len(x) for x in more]]).astype(np.int64)
    order = np.concatenate([plain, odd]).astype(np.int64)
    empty = np.asarray(pc.binary_length(texts))[order] == 0
    if empty.any():  # an empty text is no word; no other word is empty
        words, sizes = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(empty, 0, sizes)
    w = numbered(words, sizes)
    first, codes = w.starts[sizes > 0], w.codes.copy()
    names: dict[bytes, int] = {}
    codes[first] = [names.setdefault(b" " + w.table[c], len(w.table) + len(names)) for c in w.codes[first].tolist()]
    used = np.bincount(codes, minlength=len(w.table) + len(names)) > 0  # some words only come first
    table = [x for x, u in zip([*w.table, *names], used.tolist(), strict=True) if u]
    return order, Words(table, (np.cumsum(used) - 1)[codes], sizes)


def word_text(key: bytes) -> str:
    return (key[1:] if key[:1] == b" " else b" " + key).decode("utf-8", "replace")


def encode_words(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers.

    Words with a space before them are encoded many at a time and cut apart where an id's piece begins with the space,
    unless the number of such ids says that a word holds more of them."""
    tok = tokenizer(path)
    if "begins:" + path not in _loaded:
        vocab = tok.get_vocab(with_added_tokens=True)
        begins = np.zeros(max(vocab.values()) + 1, bool)
        begins[[i for piece, i in vocab.items() if piece.startswith(SPACE)]] = True
        _loaded["begins:" + path] = begins
    begins = _loaded["begins:" + path]

    def encoded(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    inner = [i for i, w in enumerate(words) if w[:1] != b" "]
    alone = [i for i, w in enumerate(words) if w[:1] == b" "]
    out: list[bytes] = [b""] * len(words)
    lots = [inner[i : i + LOT] for i in range(0, len(inner), LOT)]
    for lot, ids in zip(lots, encoded(["".join(word_text(words[i]) for i in x) for x in lots]), strict=True):
        at = np.flatnonzero(begins[ids]).tolist()
        if len(at) == len(lot) and at[0] == 0:
            raw = ids.tobytes()
            for i, a, b in zip(lot, at, [*at[1:], len(ids)], strict=True):
                out[i] = raw[4 * a : 4 * b]
        else:
            alone += lot
    for i, ids in zip(alone, encoded([word_text(words[i]) for i in alone]), strict=True):
        out[i] = ids.tobytes()
    return out


class _Flat:
    """Byte or id strings end to end, to be gathered by number."""

    def __init__(self, parts: list[bytes], dtype: str):
        width = np.dtype(dtype).itemsize
        self.size = np.fromiter(map(len, parts), np.int64, len(parts)) // width
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(parts), dtype)


def pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, in id order: at most as many as the vocabulary file has."""
    tok = tokenizer(path)
    if "pieces:" + path not in _loaded:
        byte = {c: b for b, c in BYTES.items()}
        vocab = tok.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            out[i] = bytes(byte[ord(c)] for c in piece) if all(ord(c) in byte for c in piece) else piece.encode()
        _loaded["pieces:" + path] = _Flat(out, "u1")
    return _loaded["pieces:" + path]


def texts_of(ids: Iterable[bytes], path: str) -> pa.Array:
    """The text of each string of ids, joining each id with its piece; invalid UTF-8 becomes U+FFFD."""
    table, out = pieces(path), []
    for raw in ids:
        own = np.frombuffer(raw, "<u4")
        out.append(gather(table.flat, table.start[own], table.size[own]).tobytes().decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, ids binary (little-endian unsigned 32-bit integers). decoded: adds text, as
    decode_documents() makes it, in the task that has put the ids together. A task then needs one Python worker, not two.

    1. Each chunk of texts is split once and asks for the ids of its distinct words.
    2. Each bucket encodes its distinct words, once each, and answers.
    3. The ids come back to the chunk and are put at the position of every occurrence.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    buckets = bucket_count(rows)
    table = chunk_table(rows, words_of, buckets, brings=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), held in runs(batches, "bucket"):
            asked, long = without_long(held)
            distinct, number, ends = asked_words(asked)
            made = _Flat(encode_words([long.get(w, w) for w in distinct.to_pylist()], path), "<u4")
            for r, a, b in zip(asked, [0, *ends], ends, strict=False):
                own = number[a:b]
                size = made.size[own]
                body = planes(np.concatenate([[b - a], size, gather(made.flat, made.start[own], size)]).astype("<u4"))
                yield pa.record_batch({"chunk": [r["chunk"]], "kind": pa.array([1], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "body": pa.array([body], pa.binary())})
            give_back()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head in rows_of(batches):
            sizes = np.array(head["sizes"], np.int64)
            codes, places = from_planes(head["codes"], "<u4"), from_planes(head["places"], "<u4")
            size, flat = np.zeros(len(places), np.int64), []
            at = 0
            for r in head.pop("answers") or ():
                body = from_planes(r["body"], "<u4")
                n = int(body[0])
                size[places[at : at + n]] = body[1 : n + 1]
                flat.append(body[n + 1 :])
                at += n
            flat, start = np.concatenate([np.zeros(0, "<u4"), *flat]), np.empty(len(places), np.int64)
            start[places] = np.cumsum(size[places]) - size[places]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.unique([0, *np.searchsorted(ends, np.arange(TOGETHER_WORDS, ends[-1], TOGETHER_WORDS)).tolist(), len(sizes)]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = codes[ends[a] : ends[b]]
                raw = gather(flat, start[own], size[own]).tobytes()
                words = np.concatenate([[0], np.cumsum(size[own])])[ends[a : b + 1] - ends[a]]
                ids = [raw[4 * s : 4 * e] for s, e in zip(words.tolist(), words[1:].tolist(), strict=False)]
                out = {"doc_id": pa.array(head["doc_id"][a:b], pa.int64()), "ids": pa.array(ids, pa.binary())}
                yield pa.record_batch(out | ({"text": texts_of(ids, path)} if decoded else {}))
            del codes, places, size, flat, start
            give_back()

    asked = to_buckets(requests(table), buckets, "chunk")
    answers = asked.mapInArrow(encode, "chunk long, kind int, bucket int, body binary")
    return with_answers(table, answers, buckets).mapInArrow(put, "doc_id long, ids binary" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids binary, ...): adds text, joining each id with its piece; invalid UTF-8 becomes U+FFFD."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in slices(b.column("ids"), TOGETHER_BYTES):
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(part)).columns, texts_of((x.as_py() for x in part), path)], [*b.schema.names, "text"])
                at += len(part)

    return encoded.mapInArrow(join, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", text string")
