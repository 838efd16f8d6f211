"""Runs of words that repeat periodically, by power-of-two naming (Karp, Miller and Rosenberg).

Level k names each stretch of 2**k words: equal names in a document are equal stretches. A level's names are numbers of
pairs of names of the level below, so nothing is hashed and no suffixes are sorted; a stretch that occurs once in its
document gets no name, so the levels thin out and end by themselves. For each period q the places 0, q, 2q, ... form a
grid. A run of four periods or more holds a grid place whose next q words equal the q words after them, which two names
decide. Those places, one for each streak, are extended both ways: the longest common extension of two places is found by
descending levels, adding 2**k words wherever the names agree. All documents of a stretch of a batch are named and
extended together.

A document is one row's work and no row is shuffled. Memory is a few numbers for each word and level.

Nulls: a null text has no words. Empty texts have no runs. Repeated rows and ids get a row each. Very long texts are
worked on alone, whole. An empty table gives no rows. The columns named in carry come along, whatever they are called
otherwise; no other column of docs is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.wordtable import slices, split_blanks

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass(frozen=True)
class Spec:
    """A run has at least so many words and so many periods (two or more, or grid places could miss it)."""

    words: int = 6
    periods: int = 4

    def __post_init__(self) -> None:
        if self.periods < 3:
            raise ValueError("a run needs three periods or more")


def _named(pairs: np.ndarray) -> np.ndarray:
    """Dense numbers of equal values, -1 for what occurs once."""
    _, back, count = np.unique(pairs, return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    return number[back].astype(np.int32)


def name_levels(codes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words from each place of documents laid end to end; -1 for a stretch that
    occurs once in its document or leaves it. Each level has one more place, without a name."""
    n = len(codes)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    level = np.full(n + 1, -1, np.int32)
    if n:
        level[:n] = _named(doc * (int(codes.max()) + 1) + codes)
    out = []
    while (level >= 0).any():
        out.append(level)
        half = 1 << (len(out) - 1)
        at = np.flatnonzero(level[: max(0, n - half)] >= 0)
        at = at[level[at + half] >= 0]
        new = np.full(n + 1, -1, np.int32)
        # Names differ between documents, so two halves of one name pair lie in one document.
        at = at[doc[at] == doc[at + half]]
        new[at] = _named(level[at].astype(np.int64) * (1 << 32) + level[at + half])
        level = new
    return out


def common_extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
    """How many words from places a and b on are equal, or before them."""
    n, length = len(levels[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        x, y = (a + length, b + length) if forward else (a - length - step, b - length - step)
        ok = (x >= 0) & (y <= n)
        names = levels[k][np.where(ok, x, n)]
        length += step * ((names >= 0) & (names == levels[k][np.where(ok, y, n)]))
    return length


def grid_places(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): of each streak of grid places whose next period repeats at once, the first."""
    n, places, periods = len(levels[0]) - 1, [], []
    for k, names in enumerate(levels):
        for q in range(1 << k, min(2 << k, n // 2 + 1)):
            left = names[0 : n - 2 * q + 1 : q]
            same = np.flatnonzero((left == names[q : n - q + 1 : q]) & (left >= 0))
            if len(same):
                last = same * q + q - (1 << k)  # the second name ends where the period ends
                same = same[(names[last] == names[last + q]) & (names[last] >= 0)]
            if len(same):
                first = same[np.concatenate([[True], np.diff(same) > 1])]
                places.append(first * q)
                periods.append(np.full(len(first), q, np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs_of(codes: np.ndarray, sizes: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of documents laid end to end, by start and period."""
    none = np.zeros(0, np.int64)
    levels = name_levels(codes, sizes)
    if not levels:
        return none, none, none
    at, q = grid_places(levels)
    found = []
    for i in range(0, len(at), 1 << 20):
        a, p = at[i : i + (1 << 20)], q[i : i + (1 << 20)]
        start = a - common_extension(levels, a, a + p, forward=False)
        length = a + p + common_extension(levels, a, a + p) - start
        ok = length >= np.maximum(spec.words, spec.periods * p)
        found.append(np.stack([start[ok], length[ok], p[ok]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if not len(rows):
        return none, none, none
    # One stretch under several periods: the smallest divides the others, as a run is longer than two of them together.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay if each run keeps its first period."""
    edge = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, text: Column | str = "text", carry: tuple[str, ...] = ("doc_id",), spec: Spec = Spec()) -> DataFrame:
    """(carry..., n_words, runs, collapsed) of each row: runs is an array of (start, length, period) in words by start and
    period; collapsed is the text of the words that stay, joined by one space, if each run keeps its first period."""
    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.coalesce(text, F.lit("")).cast("binary").alias("raw"))
    kept_columns = [c for c in rows.columns if c != "raw"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in slices(b.column("raw")):
                w = split_blanks(some, lower=False)
                codes = np.asarray(w.codes).astype(np.int64)
                start, length, period = runs_of(codes, w.sizes, spec)
                keep = kept_words(len(codes), start, length, period)
                ends, starts = w.ends, w.starts
                cuts = np.searchsorted(start, np.concatenate([starts[:1], ends]))
                cuts[0:1] = 0
                of = np.repeat(starts, np.diff(cuts)) if len(starts) else starts
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - of), pa.array(length), pa.array(period)], fields=list(RUNS.value_type)))
                words = [w.table[c] for c in codes[keep].tolist()]
                places = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([starts[:1], ends])].tolist()
                texts = [b" ".join(words[x:y]) for x, y in zip(places, places[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(at, len(some)) for c in kept_columns), pa.array(w.sizes, pa.int64()), lists, pa.array(texts, pa.binary())],
                    [*kept_columns, "n_words", "runs", "collapsed"],
                )
                at += len(some)

    types = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept_columns)
    out = rows.mapInArrow(work, types + "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def longest(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best.start).alias("start"), best.length.alias("length"), (-best.period).alias("period")))
