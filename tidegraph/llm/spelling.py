"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' numbers, so anagrams share it and a letter more or less
changes it by that letter's value. Each word offers its own key and, for each distinct letter, its key without that
letter. Where two words meet at a value with different letters left out (or none), their keys differ by one letter's
addition, removal or exchange, and only such words go on.

Then letter order is verified. At each place of the letter left out, a word is known by that place and hashes of what
stands before and after it (128 bits with the key); a word with nothing left out by all gaps between its letters. Words
that agree there differ by that one letter. Such a group has one word for each letter, so the alphabet bounds it, however
large a class of anagrams is, and no pairs are formed but those that are near. If a letter stands in a row of its like,
removing any of them is the same word; the first counts.

Nulls: a null text has no words; a null id counts as an empty one. Rows of one id, and repeated rows, count each. Very
long words are walked along once for each of their letters that meets another word. Empty tables give no rows. Ties
between forms go to the smaller word by code points. No column of docs but its id and its text is looked at, so others
can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.scratch import materialize

#: The letters of words, and those that are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HELD = 1 << 18  # distinct words counted in a task before they are sent off
ROWS = 1 << 16  # rows of a batch that a task gives back


def drop_letters(prefix: bytes, word: str) -> str:
    """One in 31 words, by the checksum of id and word, loses a letter: a stand-in for typing errors."""
    h = zlib.crc32(word.encode(), zlib.crc32(prefix))
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least: int = 7, edit: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """(word, n) of the runs of letters of all texts that have so many letters or more, A-Z lower-cased. edit(id and a
    colon, word) may change words first, but not make them longer. Tasks count before anything is shuffled."""
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), "text").where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{LETTERS}]{{{least},}}").findall
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for id_, text in zip(b.column("id"), b.column("text"), strict=True):
                own, prefix = Counter(find(text.as_py().translate(LOWER))), id_.as_py().encode()
                for word, n in own.items():
                    if edit is not None:
                        word = edit(prefix, word)
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield sent()
        if held:
            yield sent()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_value(letter: str) -> int:
    return ord(letter) ** 5


def _signed(value: int) -> int:
    """Modulo 2**64, as a signed number."""
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def offers(words: DataFrame) -> DataFrame:
    """words(word, n) to (word, n, letter, key): the key without each distinct letter, and for the letter '' all of it."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, n, letter, key = [], [], [], []
            for w, m in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                of = Counter(w)
                whole = sum(letter_value(c) * k for c, k in of.items())
                for c in ("", *of):
                    word.append(w)
                    n.append(m)
                    letter.append(c)
                    key.append(_signed(whole - letter_value(c) if c else whole))
                if len(word) >= ROWS:
                    yield pa.record_batch({"word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64()), "letter": pa.array(letter, pa.string()), "key": pa.array(key, pa.int64())})
                    word, n, letter, key = [], [], [], []
            yield pa.record_batch({"word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64()), "letter": pa.array(letter, pa.string()), "key": pa.array(key, pa.int64())})

    return words.select("word", "n").mapInArrow(give, "word string, n long, letter string, key long")


def places(offered: DataFrame) -> DataFrame:
    """offers() to (key, at, before, after, letter, leads, word, n): each place where the letter can be left out, with
    hashes of what stands before and after it. leads: the letter before isn't the same."""
    schema = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("letter", pa.string()), ("leads", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for b in batches:
            for r in b.to_pylist():
                word, letter = r["word"], r["letter"]
                wanted = range(len(word) + 1) if not letter else [i for i, c in enumerate(word) if c == letter]
                tail, after = xxhash.xxh3_64(), {}
                last = len(word)
                for i in reversed(wanted):
                    end = i + len(letter)
                    tail.update(word[end:last][::-1].encode())
                    last = end
                    after[i] = tail.intdigest()
                head, last = xxhash.xxh3_64(), 0
                for i in wanted:
                    head.update(word[last:i].encode())
                    last = i
                    rows.append((r["key"], i, _signed(head.intdigest()), _signed(after.pop(i)), letter, not letter or i == 0 or word[i - 1] != letter, word, r["n"]))
                    if len(rows) >= ROWS:
                        yield sent()
        if rows:
            yield sent()

    return offered.select("word", "n", "letter", "key").mapInArrow(walk, "key long, at long, before long, after long, letter string, leads boolean, word string, n long")


def links(words: DataFrame) -> DataFrame:
    """words(word, n), each word once, to (word, n, near, near_n): all ordered pairs that one inserted, deleted or replaced
    code point tells apart, each once."""
    offered = materialize(offers(words), "offers")
    met = offered.groupBy("key").agg(F.min("letter").alias("a"), F.max("letter").alias("b")).where("a <> b").select("key")
    at = places(offered.join(met, "key", "left_semi"))
    member = F.struct("letter", "leads", "word", "n")
    groups = at.groupBy("key", "at", "before", "after").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)
    pairs = groups.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    # Replaced: both leave out a letter. Inserted or deleted: one leaves out nothing, and the other the first of a row.
    near = (F.col("x.letter") != F.col("y.letter")) & (((F.col("x.letter") != "") & (F.col("y.letter") != "")) | (F.col("x.leads") & F.col("y.leads")))
    return pairs.where(near).select("x.word", "x.n", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """words(word, n), each word once, to (word, n, n_near, form, form_n, root): form is the near word of greatest n, the
    smallest of equals, if it is ratio times as frequent or more, else null; root follows forms to the last."""
    words = materialize(words.select("word", "n"), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), "near"))
    found = links(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    out = words.join(found, "word", "left").withColumn("best", F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col("best")))
    out = materialize(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")), "forms")
    # Forms grow by the ratio each step, so chains are short; each round halves what is left of them.
    root = materialize(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(root.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        root = new.select("word", "root")
        if new.where("moved").isEmpty():
            break
    return out.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
