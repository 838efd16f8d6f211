"""Language-model scores from a weighted backoff automaton over words, pairs and triples.

The states are the histories that occur in the training rows: none (the root), a word, a pair of words. From a state there
is an arc for every word that follows it there, and a failure arc to the state of the shorter history. With c occurrences
of the history, n of them before the word, and p the word's probability after the shorter history, the arc weighs
log10((n + STRENGTH * p) / (c + STRENGTH)) and the failure arc log10(STRENGTH / (c + STRENGTH)): a Dirichlet prior, so the
words' probabilities after each history add up to 1. The root has an arc for every word, log10((n + 1) / (N + V + 1)).
Every pair and triple of the training rows is an arc, however rare; there is no cut-off and no limit.

Texts are traversed once from left to right, many side by side: each carries its state, takes the arc of its next word if
the state has one, and else adds the failure arc's weight and tries again in the shorter history's state. The part of the
automaton that some texts can meet, the states and arcs of their own words, pairs and triples, is compiled from counts that
their chunk gets by two exchanges: it asks for each once at the bucket of its hash, where all chunks' counts are added up.
Nothing is broadcast, and a pair that is everywhere is asked for once a chunk. A very long text is one traversal, as many
steps as it has words.

Words are told apart by their bytes, pairs and triples by hashes of 64 bits at every size of the corpus.

Nulls: a null text is empty and has one token, its end; a null in trains trains. Null ids and repeated rows keep their
rows, and repeated rows count each time. An empty table gives no rows; without training rows every token is unknown
(N = V = 0) and weighs log10(1 / 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.wordtable import Words, asked_words, bucket_count, chunk_table, from_planes, give_back, planes, rows_of, runs, split_blanks, to_buckets, with_answers
from tidegraph.scratch import materialize

#: The token at the end of every text; no word holds a line break.
EOS = b"\n"
STRENGTH = 4.0
TOGETHER = 1 << 18  # tokens whose texts are traversed side by side; a longer text is traversed alone
STRETCH, PARTS = 1 << 17, 8  # tokens whose keys are made at a time, parts in which a chunk's keys are put in order
CHUNK = 16 << 20  # bytes of text in a chunk: the larger, the fewer pairs are asked for again
PAIR, TRIPLE = 2, 3
OUT = "doc_id long, trains boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(texts: pa.Array) -> tuple[None, Words]:
    """Words of each text with A-Z lower-cased, cut at the six ASCII white-space characters, and the end."""
    w = split_blanks(texts)
    return None, Words([*w.table, EOS], np.insert(w.codes, w.ends, len(w.table)), w.sizes + 1)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of 64-bit numbers."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, by in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    """The texts of a chunk as tokens, by their numbers in the chunk, and of each number the word's number in the corpus (0 is
    before the first) and its training count."""

    codes: np.ndarray
    word: np.ndarray
    count: np.ndarray
    sizes: np.ndarray
    answers: list[dict]

    @classmethod
    def of(cls, row: dict) -> Chunk:
        answers = row.pop("answers")
        codes, places = from_planes(row.pop("codes"), "<u4"), from_planes(row.pop("places"), "<u4")
        word, count, at = np.empty(len(places), np.uint64), np.empty(len(places), np.int64), 0
        for r in answers:
            if r["kind"] == 1:
                got = from_planes(r["body"], "<u8").reshape(2, -1)
                here = places[at : at + got.shape[1]]
                word[here], count[here], at = got[0] + np.uint64(1 + (r["bucket"] << 32)), got[1], at + len(here)
        return cls(codes, word, count, np.array(row["sizes"], np.int64), [r for r in answers if r["kind"] != 1])

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token the key of the pair or triple that it ends, and whether it ends one. Made by stretches."""
        first = np.zeros(len(self.codes), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        key = np.empty(len(first), np.uint64)
        for a in range(0, len(first), STRETCH):
            low, high = max(a - 2, 0), a + STRETCH
            ids = self.word[self.codes[low:high]]
            before = np.concatenate([np.zeros(1, np.uint64), ids[:-1]])
            before[first[low:high]] = 0
            made = joined(before, ids)
            if kind == TRIPLE:
                made[1:] = joined(made[:-1], ids[1:])
            key[a:high] = made[a - low :]
        return key, np.ones_like(first) if kind == PAIR else ~first

    def parts(self, kind: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs or triples by ranges of buckets of their keys, so that only a part is put in order at a time: the first
        bucket, the one after the last, the places of the tokens that end them, the keys, ascending, and which are new."""
        key, inner = self.keys(kind)
        begins = [(i << 64) // buckets for i in range(buckets)]
        cuts = sorted({buckets * i // PARTS for i in range(PARTS + 1)})
        for low, high in zip(cuts, cuts[1:], strict=False):
            mine = inner & (key >= np.uint64(begins[low]))
            if high < buckets:
                mine &= key < np.uint64(begins[high])
            at = np.flatnonzero(mine)
            if len(at):
                own = key[at]
                by, new = ordered(own)
                yield low, high, at[by], own[by], new

    def questions(self, kind: int, buckets: int, learns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each bucket that the chunk asks for pairs or triples, with their keys and how often they occur in texts that learn."""
        learns = np.repeat(learns, self.sizes)
        for low, high, at, key, new in self.parts(kind, buckets):
            first = np.flatnonzero(new)
            n, key = np.add.reduceat(learns[at], first, dtype="<u4"), key[first]
            cuts = [0, *np.searchsorted(key, np.array([(i << 64) // buckets for i in range(low + 1, high)], np.uint64)).tolist(), len(key)]
            yield from ((b, key[s:e], n[s:e]) for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False), low) if s < e)

    def counts(self, kind: int, buckets: int) -> np.ndarray:
        """The training count of the pair or triple that each token ends."""
        out = np.zeros(len(self.codes), np.int64)
        for low, high, at, _, new in self.parts(kind, buckets):
            found = np.concatenate([from_planes(r["body"], "<u8") for r in self.answers if r["kind"] == kind and low <= r["bucket"] < high])
            out[at] = found[np.cumsum(new) - 1]
        return out


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which keys ascend, and whether a place in it has another key than the one before."""
    by = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = np.diff(keys[by]) != 0
    return by, new


def weighed(row: dict, buckets: int, tokens: int, distinct: int, texts: int, strength: float) -> Iterator[pa.RecordBatch]:
    """The scores of a chunk's texts. Automata are compiled for TOGETHER tokens at a time, as they take many times the memory of the tokens."""
    chunk = Chunk.of(row)
    pairs, triples = chunk.counts(PAIR, buckets), chunk.counts(TRIPLE, buckets)
    chunk.answers.clear()
    ends = np.cumsum(chunk.sizes)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(TOGETHER, ends[-1], TOGETHER)).tolist(), len(ends)]).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        sizes = chunk.sizes[a:b]
        own, starts = slice(ends[a] - sizes[0], ends[b - 1]), np.cumsum(sizes) - sizes
        table, cur = np.unique(chunk.codes[own], return_inverse=True)
        cur, count = cur.astype(np.int64) + 1, chunk.count[chunk.codes[own]]
        model = Automaton.of(cur, count, pairs[own], triples[own], starts, len(table) + 1, tokens, distinct, texts, strength)
        base = np.log10((count + 1) / (tokens + distinct + 1))
        sums = [*(np.add.reduceat(v, starts) for v in ((count > 0).astype(np.int64), base)), model.run(cur, starts, sizes)]
        yield pa.record_batch({"doc_id": pa.array(row["doc_id"][a:b], pa.int64()), "trains": pa.array(row["trains"][a:b], pa.bool_()), "n_tokens": pa.array(sizes), "n_known": pa.array(sums[0]), "train_tokens": pa.array(np.full(len(sizes), tokens)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})


@dataclass
class Automaton:
    """States (0 is the root): the state of the shorter history and the weight of the failure arc to it. Arcs, ascending by
    state and word: weight and the state that they lead to; begin is the state before a text."""

    fail: np.ndarray
    fail_weight: np.ndarray
    arcs: np.ndarray
    weight: np.ndarray
    to: np.ndarray
    words: int
    begin: int

    @classmethod
    def of(cls, cur: np.ndarray, count: np.ndarray, pairs: np.ndarray, triples: np.ndarray, starts: np.ndarray, words: int, tokens: int, vocabulary: int, texts: int, strength: float) -> Automaton:
        """The states and arcs that some whole texts can meet. cur: their words' numbers, from 1 to words - 1; count, pairs,
        triples: training counts of the word, pair and triple that each token ends."""
        prev = np.empty_like(cur)
        prev[1:] = cur[:-1]
        prev[starts] = 0
        seen, at = np.unique(cur, return_index=True)
        total = np.zeros(words, np.int64)  # of words as histories; 0 is the history before a text
        total[seen], total[0] = count[at], texts
        p1 = np.zeros(words)
        p1[seen] = (count[at] + 1) / (tokens + vocabulary + 1)
        state = np.where(total > 0, np.arange(words) + 1, 0)
        some = np.flatnonzero(pairs > 0)
        pair, at = np.unique(prev[some] * words + cur[some], return_index=True)
        n2, a, b = pairs[some[at]], pair // words, pair % words
        p2 = (n2 + strength * p1[b]) / (total[a] + strength)
        some = np.flatnonzero(triples > 0)
        here = np.searchsorted(pair, prev[some] * words + cur[some])
        source = words + 1 + np.searchsorted(pair, prev[some - 1] * words + prev[some])
        triple, at = np.unique(source * words + cur[some], return_index=True)
        n3, here, source = triples[some[at]], here[at], source[at]
        p3 = (n3 + strength * p2[here]) / (n2[source - words - 1] + strength)
        totals = np.concatenate([[0], total, n2])
        return cls(
            np.concatenate([np.zeros(words + 1, np.int64), state[b]]),
            np.log10(strength / (totals + strength)),
            np.concatenate([seen, (a + 1) * words + b, triple, [np.iinfo(np.int64).max]]),
            np.log10(np.concatenate([p1[seen], p2, p3])),
            np.concatenate([state[seen], words + 1 + np.arange(len(pair)), words + 1 + here]),
            words,
            int(state[0]),
        )

    def run(self, cur: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The weight along each text's arcs."""
        by = np.argsort(-sizes, kind="stable")
        first, long = starts[by], sizes[by]
        state, out = np.full(len(by), self.begin, np.int64), np.zeros(len(by))
        active = np.searchsorted(-long, -np.arange(int(long[0]) if len(long) else 0), side="left")
        for step, k in enumerate(active.tolist()):
            word, here = cur[first[:k] + step], state[:k]
            key = here * self.words + word
            arc = np.searchsorted(self.arcs, key)
            missed = np.flatnonzero(self.arcs[arc] != key)
            while len(missed):  # the root has an arc for every word
                out[missed] += self.fail_weight[here[missed]]
                here[missed] = self.fail[here[missed]]
                key = here[missed] * self.words + word[missed]
                found = np.searchsorted(self.arcs, key)
                arc[missed] = found
                missed = missed[self.arcs[found] != key]
            out[:k] += self.weight[arc]
            state[:k] = self.to[arc]
        weight = np.empty(len(by))
        weight[by] = out
        return weight


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH) -> DataFrame:
    """One row for each row of docs: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score.

    trains: which rows the model learns from. strength: of the prior, in occurrences."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(trains, F.lit(True)).alias("trains"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    buckets = bucket_count(rows)
    table = chunk_table(rows, tokens_of, buckets, "trains", CHUNK)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), asked in runs(batches, "bucket"):
            distinct, number, ends = asked_words(asked)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, number, np.concatenate([from_planes(r["counts"], "<u8") for r in asked]).astype(np.int64))
            whole = (int(total.sum()), int((total > 0).sum()))
            for r, a, b in zip(asked, [0, *ends], ends, strict=False):
                own = number[a:b]
                body = planes(np.concatenate([own, total[own]]).astype("<u8"))
                yield pa.record_batch({"chunk": [r["chunk"]], "kind": pa.array([1], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "body": pa.array([body], pa.binary()), "tokens": [whole[0]], "words": [whole[1]]})
                whole = (0, 0)

    asked = to_buckets(table.select("chunk", F.inline("requests")), buckets, "chunk")
    words = materialize(asked.mapInArrow(count_words, "chunk long, kind int, bucket int, body binary, tokens long, words long"), "words")
    seen = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    size = table.agg(F.sum(F.size(F.filter("trains", lambda x: x)))).first()
    tokens, distinct, texts = seen[0], seen[1], size[0] or 0

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            number, learns, chunk = row["chunk"], np.array(row["trains"], bool), Chunk.of(row)
            for kind in (PAIR, TRIPLE):
                some = [(b, len(key), planes(np.diff(key, prepend=np.uint64(0))), planes(n)) for b, key, n in chunk.questions(kind, buckets, learns)]
                if some:
                    own, n, keys, counts = zip(*some, strict=True)
                    yield pa.record_batch({"bucket": pa.array(own, pa.int32()), "kind": pa.array([kind] * len(own), pa.int32()), "chunk": pa.array([number] * len(own), pa.int64()), "n": pa.array(n, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})
            del chunk
            give_back()

    def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, kind), held in runs(batches, "bucket", "kind"):
            ends, of = np.cumsum([r["n"] for r in held]).tolist(), [r["chunk"] for r in held]
            key = np.concatenate([np.cumsum(from_planes(r["keys"], "<u8")) for r in held])
            n = np.concatenate([from_planes(r["counts"], "<u4") for r in held]).astype(np.int64)
            held.clear()
            by, new = ordered(key)
            total = np.empty(len(key), "<u8")
            total[by] = np.add.reduceat(n[by], np.flatnonzero(new))[np.cumsum(new) - 1]
            bodies = [planes(total[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            del by, new, key, n, total
            yield pa.record_batch({"chunk": pa.array(of, pa.int64()), "kind": pa.array([kind] * len(of), pa.int32()), "bucket": pa.array([bucket] * len(of), pa.int32()), "body": pa.array(bodies, pa.binary())})
            give_back()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from weighed(row, buckets, tokens, distinct, texts, strength)
            give_back()

    asked = with_answers(table, words, buckets).mapInArrow(ask, "bucket int, kind int, chunk long, n int, keys binary, counts binary")
    counted = to_buckets(asked, buckets, "kind", "chunk").mapInArrow(count_keys, "chunk long, kind int, bucket int, body binary")
    return with_answers(table, words.drop("tokens", "words").unionByName(materialize(counted, "ngrams")), buckets).mapInArrow(weigh, OUT)
