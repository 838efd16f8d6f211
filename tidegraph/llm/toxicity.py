"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon's words and stems (plain, and after undoing look-alike characters),
their nearness to second-person words and their densest stretch, capitals, punctuation and obfuscation rates. The
lexicon has a short fixed part and a part learnt from labelled rows: words and word beginnings that toxic texts have
much oftener.

Everything is cross-fitted, alike at every size. Labelled rows are dealt to FOLDS. A row's features come from a lexicon of
the other folds, so trees meet lexicons as they meet them on new texts. Trees of the other folds score each row, and one
isotonic curve is fitted on all these scores. The trees that score documents are fitted on all rows, and their lexicon is
learnt from all.

The only bound: at most SAMPLE labelled documents are fitted on, those with the smallest hashes of their ids, one text
of each; that bounds the lexicon too. Every document is scored, whole, however long.

Nulls: a null text is empty, and empty texts get a score like any other; labels other than 0 and 1 are left out. Of
repeated labels the highest counts, of different texts under one id one is learnt from. Repeated documents are scored each,
and equal texts get equal scores. An empty table gives no rows. With fewer than two labelled documents of either kind there
is nothing to tell apart: every score is the share of toxic ones, or 0 where that is a half or more, so that no document is
rejected unseen. Columns besides the text come back as
they were, whatever they are called; one called score gives way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tidegraph.llm.wordtable import slices
from tidegraph.scratch import materialize

#: Labelled rows to fit on; words that a worker remembers its look at.
SAMPLE, MEMORY = 20_000, 500_000
#: The labelled rows of each kind are dealt to so many folds by the hash of their ids; so many fits run at once, as the
#: driver's heap grew with their number.
FOLDS, AT_ONCE = 5, 2
#: Insults, second-person words, look-alike characters.
INSULTS = frozenset("bastard clown creep cretin degenerate disgusting dumb failure filth fool garbage idiot idiotic imbecile jerk loser lunatic moron moronic pathetic pig psycho rat scum stupid trash vermin worthless".split())
YOU = frozenset("you your yours yourself yourselves youre u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tuyo usted ustedes vosotros os vuestro".split())
LOOKALIKE = str.maketrans("0134578@$!|€", "oieastbasiie")
STRIP = ".,;:!?\"'()[]{}<>*_~`«»„“”‘’-…|/\\#%&="
NEAR, STRETCH = 4, 100
FEATURES = ("log_words", "lexicon", "stems", "obfuscated_hits", "log_hits", "distinct_hits", "near_you", "you", "stretch", "capital_words", "capitals", "punctuation", "shouts", "obfuscation", "repeats", "digits")
_memo: dict = {}


def terms_of(core: str) -> list[str]:
    """The terms by which a word can be in the lexicon: itself and its beginnings of 4 to 6 characters."""
    return ["w:" + core, *("p:" + core[:n] for n in (4, 5, 6) if len(core) > n)]


def _look(word: str, lexicon: frozenset[str]) -> tuple[int, int, int, int]:
    """Flags, capitals, punctuation marks, digits of a word."""
    core = word.strip(STRIP).lower()
    plain = "".join(c for c in core.translate(LOOKALIKE) if c.isalpha())
    hit = core in INSULTS or "w:" + core in lexicon
    stem = not hit and any(t in lexicon for t in terms_of(core)[1:])
    hidden = not hit and not stem and plain != core and len(plain) > 2 and (plain in INSULTS or any(t in lexicon for t in terms_of(plain)))
    caps, digits = sum(c.isupper() for c in word), sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    inner = len(core) > 2 and letters > 1 and letters < len(core) and core[0].isalnum() and "@" not in core[1:-1] and "." not in core
    flags = hit | stem << 1 | hidden << 2 | (core in YOU) << 3 | (caps > 2 and caps == letters) << 4 | ("!" in word) << 5 | inner << 6
    flags |= any(a == b == c and a.isalpha() for a, b, c in zip(core, core[1:], core[2:], strict=False)) << 7
    return flags, caps, len(word) - letters - digits, digits


def features(texts: pa.Array, lexicon: frozenset[str], memo: dict[str, tuple]) -> np.ndarray:
    """FEATURES of each text, a row of zeros for one without words. Each distinct word is looked at once."""
    lists = pc.utf8_split_whitespace(texts)
    words, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    full = np.asarray(pc.binary_length(words)) > 0  # outer white space leaves empty words
    sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(sizes)])])
    coded = words.filter(pa.array(full)).dictionary_encode()
    table, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if len(memo) > MEMORY:
        memo.clear()
    looks = np.zeros((len(table), 4), np.int64)
    for i, w in enumerate(table):
        if (x := memo.get(w)) is None:
            x = memo[w] = _look(w, lexicon)
        looks[i] = x
    ends = np.cumsum(sizes)
    starts = ends - sizes

    def sums(column: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(column[codes])])
        return (run[ends] - run[starts]).astype(float)

    flags = looks[:, 0]
    rate = [sums(flags >> bit & 1) / np.maximum(sizes, 1) for bit in range(8)]
    caps, marks, digits = (sums(looks[:, k]) / np.maximum(np.asarray(pc.utf8_length(texts)), 1) for k in (1, 2, 3))
    all_flags = flags[codes]
    at, you = np.flatnonzero(all_flags & 7), np.flatnonzero(all_flags & 8)
    doc = np.searchsorted(ends, at, side="right")
    hits, near, distinct, stretch = (np.zeros(len(sizes)) for _ in range(4))
    if len(at):
        hits = np.bincount(doc, minlength=len(sizes)).astype(float)
        close = np.zeros(len(at), bool)
        if len(you):
            i = np.searchsorted(you, at)
            for other in (you[np.minimum(i, len(you) - 1)], you[np.maximum(i - 1, 0)]):
                close |= (np.abs(other - at) <= NEAR) & (other >= starts[doc]) & (other < ends[doc])
        near = np.bincount(doc[close], minlength=len(sizes)) / np.maximum(sizes, 1)
        cores: dict[str, int] = {}
        core = np.zeros(len(table), np.int64)
        for c in np.unique(codes[at]).tolist():
            core[c] = cores.setdefault(table[c].strip(STRIP).lower(), len(cores))
        distinct = np.bincount(np.unique(doc * len(cores) + core[codes[at]]) // len(cores), minlength=len(sizes)).astype(float)
        # The densest stretch can begin at a hit.
        dense = np.searchsorted(at, np.minimum(at + STRETCH, ends[doc])) - np.arange(len(at))
        np.maximum.at(stretch, doc, dense)
        stretch /= np.maximum(np.minimum(sizes, STRETCH), 1)
    out = np.stack([np.log1p(sizes), *rate[:3], np.log1p(hits), distinct, near, rate[3], stretch, rate[4], caps, marks, *rate[5:8], digits], axis=1)
    out[sizes == 0] = 0
    return out


def with_features(rows: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """rows(..., text): adds x, the array of FEATURES, and drops the text."""
    keep = [c for c in rows.columns if c != "text"]
    held = rows.sparkSession.sparkContext.broadcast(lexicon)  # of at most SAMPLE texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _memo.get("of") is not held:
            _memo["of"], _memo["words"] = held, {}
        for b in batches:
            at = 0
            for part in slices(pc.fill_null(b.column("text"), "")):
                x = features(part, held.value, _memo["words"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(part)) for c in keep), lists], [*keep, "x"])
                at += len(part)

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in keep), StructField("x", ArrayType(DoubleType()))]))


def learn_lexicons(rows: DataFrame, odds: float = 12.0, least: int = 3) -> list[frozenset[str]]:
    """Of rows(text, label, fold) the lexicon without each fold, and last the one of all: terms that least toxic rows have,
    and whose document frequency among toxic rows is `odds` times that among clean ones."""
    sums = {f: [0, 0] for f in range(FOLDS)}
    for r in rows.groupBy("fold", "label").count().collect():
        sums[r.fold][int(r.label)] += r["count"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, list[int]] = {}

        def sent() -> pa.RecordBatch:
            out = pa.record_batch({"term": pa.array(count, pa.string()), "n": pa.array(list(count.values()), pa.list_(pa.int64()))})
            count.clear()
            return out

        for b in batches:
            for t, y, f in zip(*(b.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                cores = {w.strip(STRIP).lower() for w in (t or "").split()}
                for term in {x for c in cores if len(c) > 1 for x in terms_of(c)}:
                    count.setdefault(term, [0] * (2 * FOLDS))[2 * f + int(y)] += 1
            if len(count) > 500_000:
                yield sent()
        if count:
            yield sent()

    counted = rows.select("text", "label", "fold").mapInArrow(partial, "term string, n array<long>")
    found = counted.groupBy("term").agg(*(F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(2 * FOLDS)))
    chosen = []
    for left_out in [*range(FOLDS), None]:
        folds = [f for f in range(FOLDS) if f != left_out]
        clean, toxic = (sum((F.col(f"n{2 * f + y}") for f in folds), F.lit(0)) for y in (0, 1))
        ratio = (toxic + 0.5) / (sum(sums[f][1] for f in folds) + 1.0) / ((clean + 0.5) / (sum(sums[f][0] for f in folds) + 1.0))
        chosen.append((toxic >= least) & (ratio >= odds))
    terms = found.select("term", F.array(*chosen).alias("in")).where(F.exists("in", lambda x: x)).collect()  # of at most SAMPLE texts
    return [frozenset(r.term for r in terms if r["in"][i]) for i in range(FOLDS + 1)]


def fit(docs: DataFrame, labels: DataFrame, learns: Column, sample: int = SAMPLE):
    """A function from rows(..., text) to rows(..., score). learns: which labelled rows, by doc_id, may be learnt from."""
    picked = labels.where(learns & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # `sample` rows of 16 bytes at most
    rows = materialize(rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "labelled")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    folds = rows.select("doc_id", "label").distinct().withColumn("fold", F.row_number().over(order) % FOLDS)
    rows = materialize(rows.join(F.broadcast(folds), ["doc_id", "label"]), "labelled")  # as many rows at most
    known = {r.label: r["n"] for r in rows.groupBy("label").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if min(known.get(y, 0) for y in (0.0, 1.0)) < 2:
        share = known.get(1.0, 0) / max(1, sum(known.values()))
        alike = F.lit(share if share < 0.5 else 0.0)
        return lambda texts: texts.select(*(F.col(f"`{c}`") for c in texts.columns if c not in ("text", "score")), alike.alias("score"))
    *without, lexicon = learn_lexicons(rows)
    of_fold = [with_features(rows.where(F.col("fold") == f).select("fold", "label", "text"), without[f]) for f in range(FOLDS)]
    data = materialize(reduce(DataFrame.unionByName, of_fold).coalesce(4), "features").withColumn("features", array_to_vector("x"))
    grow = GBTClassifier(featuresCol="features", labelCol="label", maxIter=16, maxDepth=4, stepSize=0.2, seed=7, cacheNodeIds=False).fit

    def probability(trees: GBTClassificationModel, x: DataFrame) -> DataFrame:
        return trees.transform(x).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def unseen(f: int) -> DataFrame:
        return probability(grow(data.where(F.col("fold") != f).coalesce(4)), data.where(F.col("fold") == f)).select("label", "p")

    with ThreadPool(AT_ONCE) as pool:
        whole = pool.apply_async(inheritable_thread_target(rows.sparkSession)(lambda: grow(data.coalesce(4))))
        scored = pool.map(inheritable_thread_target(rows.sparkSession)(unseen), range(FOLDS))
        trees = whole.get()
    curve = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(reduce(DataFrame.unionByName, scored).coalesce(1))

    def apply(texts: DataFrame) -> DataFrame:
        kept = F.struct(*(F.col(f"`{c}`") for c in texts.columns if c not in ("text", "score")), F.lit(None).cast("string").alias("_")).alias("row")
        x = with_features(texts.select(kept, "text"), lexicon).withColumn("features", array_to_vector("x"))
        out = curve.transform(probability(trees, x)).select("row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
        return out.drop("_")

    return apply
