"""Toxicity, top-k search, chat formatting and the pipeline."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import bpe, chat, topk, toxicity
from tidegraph.llm.queries import chat_digest, vocabulary


def toxic_rows(n=400):
    rng = random.Random(5)
    clean = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(80)]
    out, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgak", "zorgaks", "zorgakly", "idiot", "1d10t"]))
        out.append((i, " ".join(w), 0.0))
        labels.append((i, 1, y))
    return out, labels


def test_toxicity_learns_a_lexicon(spark):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows + [(None, None, 1.0), (900, "", 1.0), (0, rows[0][1], 1.0)], "doc_id long, text string, score double"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    score = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0)
    out = score(docs.select("doc_id", "text")).collect()
    assert len(out) == len(docs.collect()) and all(0 <= r.score <= 1 for r in out)
    truth = {d: y for d, _, y in labels}
    held = [r for r in out if r.doc_id in truth and r.doc_id % 5 == 0]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) >= 0.97 * len(held)
    assert score(docs.where("false").select("doc_id", "text")).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.fit(docs, none, F.lit(True))(docs).collect()] == [0.0]


def feature_by_feature(text, lexicon):
    """The features of one text, word by word."""
    T, words = toxicity, text.split()
    n = len(words)
    if not n:
        return [0.0] * len(T.FEATURES)
    kind, cores = [], [w.strip(T.STRIP).lower() for w in words]
    terms = lambda c: ["w:" + c] + ["p:" + c[:k] for k in (4, 5, 6) if len(c) > k]
    for c in cores:
        plain = "".join(x for x in c.translate(T.LOOKALIKE) if x.isalpha())
        if c in T.INSULTS or "w:" + c in lexicon:
            kind.append("word")
        elif any(t in lexicon for t in terms(c)[1:]):
            kind.append("stem")
        elif plain != c and len(plain) > 2 and (plain in T.INSULTS or any(t in lexicon for t in terms(plain))):
            kind.append("hidden")
        else:
            kind.append("")
    hits, you = [i for i in range(n) if kind[i]], [i for i in range(n) if cores[i] in T.YOU]
    share = lambda xs: sum(map(bool, xs)) / n
    letters = [sum(x.isalpha() for x in w) for w in words]
    caps, digits = [sum(x.isupper() for x in w) for w in words], [sum(x.isdigit() for x in w) for w in words]
    inner = [len(c) > 2 and 1 < k < len(c) and c[0].isalnum() and "@" not in c[1:-1] and "." not in c for c, k in zip(cores, letters, strict=True)]
    triple = [any(c[i].isalpha() and c[i : i + 3] == c[i] * 3 for i in range(len(c) - 2)) for c in cores]
    densest = max(sum(bool(kind[j]) for j in range(i, min(i + T.STRETCH, n))) for i in range(n))
    return [
        math.log1p(n), share(k == "word" for k in kind), share(k == "stem" for k in kind), share(k == "hidden" for k in kind), math.log1p(len(hits)), len({cores[i] for i in hits}),
        share(any(abs(i - j) <= T.NEAR for j in you) for i in hits), len(you) / n, densest / min(n, T.STRETCH), share(c > 2 and c == k for c, k in zip(caps, letters, strict=True)),
        sum(caps) / len(text), (sum(map(len, words)) - sum(letters) - sum(digits)) / len(text), share("!" in w for w in words), share(inner), share(triple), sum(digits) / len(text),
    ]


def test_every_feature_equals_a_plain_count():
    rng = random.Random(4)
    words = ["you", "DU", "1d10t", "!!!", "STOP", "zork", "zorks", "z0rks", "ünïcödé", "soooo", "s.o.p", "a@b", "(idiot)", "w0rd5", "42", "ß", "stupid!", "clean", "words", "here", "and", "more"]
    lexicon = frozenset(["w:zork", "p:zork", "p:clea"])
    texts = ["", "  ", "you 1d10t !!! STOP", "A" * 1000, "!" * 700 + " idiot", "9" * 300, " lead and trail\n", " ".join(["idiot"] * 250)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    got, memo = toxicity.features(pa.array(texts), lexicon, {}), {}
    for i, t in enumerate(texts):
        assert got[i].tolist() == pytest.approx(feature_by_feature(t, lexicon)), t[:50]
        assert toxicity.features(pa.array([t]), lexicon, memo)[0].tolist() == pytest.approx(got[i].tolist())
    x = dict(zip(toxicity.FEATURES, got[3], strict=True))
    assert x["capitals"] == 1.0


def test_repeated_rows_and_labels_of_one_kind(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").select("doc_id", "text")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = {}
    for r in toxicity.fit(docs, marks, F.lit(True), sample=300)(docs.unionByName(docs)).collect():
        assert seen.setdefault(r.doc_id, r.score) == r.score  # repeated rows score alike
    one_kind = marks.where("toxic = 1")
    assert {r.score for r in toxicity.fit(docs, one_kind, F.lit(True))(docs).collect()} == {0.0}


@pytest.mark.parametrize("shard, block", [(4096, 1024), (7, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(150)]
    rows += [(150 + i, rows[0][1]) for i in range(30)] + [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan")] * 4), (350, [math.inf, 0.0, 0.0, 0.0]), (400, [1.0, 2.0]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    exact = {r.vec_id: [math.floor(256 * float(x)) for x in r.embedding] for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)}
    want = set()
    for q in exact:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q and len(v) == len(exact[q]))
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:5])}
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_repeated_ids_and_large_components(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (51, [1.0, 0.0]), (52, [2.0, 0.0]), (52, [2.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 3).collect()
    s = 1 << 16
    assert sorted(map(tuple, got)) == sorted([(50, 1, 52, 2 * s), (50, 2, 52, 2 * s), (50, 3, 51, s), (100, 1, 52, 2 * s), (100, 2, 52, 2 * s), (100, 3, 50, s), (100, 1, 50, 0), (100, 2, 50, 0), (100, 3, 51, 0)])
    big = spark.createDataFrame([(0, [1e8] * 64), (1, [1e8] * 64), (2, [-1e30] * 64), (3, [1e12] * 64)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(big, F.col("vec_id") == 0).collect()}
    assert got == {1: 64 * (256 * 10**8) ** 2 if 64 * (256 * 10**8) ** 2 < 1 << 63 else (1 << 63) - 1, 2: -(1 << 63), 3: (1 << 63) - 1}


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>x<\\|end|><|text|>", "[[INST]] \\ <\\\\s> $1", "", None, "a\nb", "\U0001f600"]
    rows = [(c, t, r, hard[(c + t) % 7]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(9, 0, None, "x"), (9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (9, None, "a<|text|>b", "y"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = {r.conv_id: r for r in chat_digest(df).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda v: v)
        spoken = "".join(f"{r}\n{x}\n" for *_, r, x in mine)
        said = "".join(x for *_, r, x in mine if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(mine), hashlib.sha256(spoken.encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_digest(df.where("false")).count() == 0


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 1, 1, "delta", "user", "he"), (1, 2, 1, "delta", "user", "llo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 3, "delta", "user", "gone"), (1, 5, 2, "regenerate", "assistant", None), (1, 6, 2, None, "assistant", "go"), (1, 7, 2, "delta", "assistant", "od"), (1, 8, 4, "delta", "user", "thanks"), (2, 1, 1, "delta", "user", "a"), (2, 2, 1, "edit", "user", "b")]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string").repartition(3)
    got = sorted(tuple(r) for r in chat.fold(events).collect())
    assert got == [(1, 1, "user", "hello"), (1, 2, "assistant", "good"), (1, 4, "user", "thanks"), (2, 1, "user", "b")]
    r = chat.render(chat.fold(events)).where("conv_id = 1").first()
    assert [r.formatted[s.start : s.end] for s in r.loss] == ["good"]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_near_duplicates(rows):
    """The rows that stay: (doc_id, text, ...) of each group, by comparing all pairs."""
    def shingles(t):
        w = WORD.findall((t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(("group", find(i)) if sets[i] else ("empty", r[0]), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_mix(rows):
    """(row, times), one source at a time, whole epochs first and then by the hash of ids."""
    size = lambda r: len(WORD.findall(r[1] or ""))
    sources = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    weight, held = {x: (3, 1, 2)[i % 3] for i, x in enumerate(sources)}, {x: sum(size(r) for r in rows if r[3] == x) for x in sources}
    capped = set()
    while True:
        level = (1.5 * sum(held.values()) - sum(2 * held[x] for x in capped)) / max(1, sum(weight[x] for x in sources if x not in capped))
        if not (over := {x for x in sources if x not in capped and level * weight[x] > 2 * held[x]}):
            break
        capped |= over
    out = []
    for x in sources:
        budget = math.floor(2.0 * held[x] if x in capped else level * weight[x])
        epochs = budget // held[x] if held[x] else 0
        left = budget - epochs * held[x]
        for r in sorted((r for r in rows if r[3] == x), key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r))):
            n = size(r)
            taken = epochs * n + min(n, max(0, left))
            left -= n
            out.append((r, (2 * taken + n) // (2 * n) if n else 1))
    return [(r, t) for r, t in out if t]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rows, labels = toxic_rows(300)
    text = " ".join(f"w{i}" for i in range(60))
    more = [(1000, text), (1001, text), (1002, text.replace("w30", "v30")), (1003, "password=abcdefgh1 é"), (1004, None), (1005, ""), (1006, "one"), (1006, "two words here"), (1006, "one"), (None, text), (None, "no id here"), (None, "no id here")]
    docs = [(d, t, "en", [f"s{d % 3}", None][d % 7 == 0], len(t), d, "x") for d, t, _ in rows] + [(d, t, "en", "s1", len(t or ""), 7, "y") for d, t in more]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, spans long, blob string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    calm = p.drop_toxic(spark, docs, sf)
    assert calm.schema == docs.schema
    left, toxic = {r.doc_id for r in calm.collect()}, {d for d, _, y in labels if y}
    assert len(left & toxic) <= 3 and len({r[0] for r in rows} - toxic - left) <= 3 and {r[0] for r in more} <= left
    scores = toxicity.fit(docs, spark.read.parquet(sf + "/labels.parquet"), p.remainder(F.col("doc_id"), 5) != 0)(docs)
    assert sorted(left, key=repr) == sorted({r.doc_id for r in scores.where("score < 0.5").collect()}, key=repr)
    single = p.drop_near_duplicates(spark, docs, sf)
    kept = plain_near_duplicates([tuple(r) for r in docs.collect()])
    assert single.schema == docs.schema and sorted((r[0:2] for r in plain(single)), key=repr) == sorted((r[0:2] for r in kept), key=repr)
    safe = p.redact_secrets(spark, docs, sf)
    want = [(*r[:1], "[REDACTED] é", *r[2:4], 12, *r[5:]) if r[0] == 1003 else r for r in plain(docs)]
    assert safe.schema.simpleString() == docs.schema.simpleString() and plain(safe) == sorted(want, key=repr)
    mixed = p.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns and plain(mixed) == sorted((r for r, n in plain_mix(plain(docs)) for _ in range(n)), key=repr)
    encode = bpe.tokenizer(vocabulary("byte_bpe_50k.json")).encode
    done = sorted(((r.doc_id, r.n_tokens, bytes(r.ids)) for r in p.run(spark, sf).collect()), key=repr)
    rest = plain_near_duplicates(plain(calm))
    rest = [(*r[:1], "[REDACTED] é", *r[2:]) if r[0] == 1003 else r for r in rest]
    want = [(r[0], ids) for r, n in plain_mix(rest) for ids in [encode(r[1] or "", add_special_tokens=False).ids] for _ in range(n)]
    assert done == sorted(((d, len(ids), np.array(ids, "<u4").tobytes()) for d, ids in want), key=repr)
    none = docs.where("false")
    for _, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_pipeline_carries_maps_arrays_and_structs(spark, tmp_path):
    import corpus_pipeline as p

    rows, labels = toxic_rows(120)
    docs = [(d, t, f"s{d % 2}", {"a": str(d)} if d % 3 else None, [(d, None)], ({"k": d}, "x"), 0.5) for d, t, _ in rows]
    docs += [docs[1], docs[1], (*docs[1][:3], {"b": "other"}, *docs[1][4:]), (None, None, None, {}, [], None, None)]
    schema = "doc_id long, text string, source string, `meta data` map<string,string>, features array<struct<x:long,probability:double>>, row struct<m:map<string,long>,score:string>, score double"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        count = out.groupBy("doc_id").count().where("doc_id = 1").collect()
        assert count[0]["count"] == (1 if stage is p.drop_near_duplicates else 4) or stage is p.mix_sources
    assert p.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids"]


def test_toxicity_keeps_columns_of_any_name(spark):
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame([(i, t, [i], "f", i * 0.5, {"a": i}, "old") for i, t, _ in rows], "doc_id long, text string, x array<int>, features string, probability double, prediction map<string,int>, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.fit(docs, marks, F.lit(True))(docs)
    assert out.columns == ["doc_id", "x", "features", "probability", "prediction", "score"] and out.schema["score"].dataType.typeName() == "double"
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].x == [i] and got[i].prediction == {"a": i} and got[i].probability == i * 0.5 for i, *_ in rows)
    truth = {d: y for d, _, y in labels}
    assert sum((r.score >= 0.5) == bool(truth[d]) for d, r in got.items()) >= 0.97 * len(got) and len({r.score for r in got.values()}) >= 2
    # Fewer than two labels of a kind: nothing to tell apart.
    few = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.fit(docs, few, F.lit(True))(docs).collect()} == {0.25}
    assert {r.score for r in toxicity.fit(docs, few.limit(0), F.lit(True))(docs).collect()} == {0.0}
    # Two labels of a kind are fitted on like any other number.
    two = spark.createDataFrame([(i, 1, int(truth[i])) for i in [*[d for d in truth if truth[d]][:2], *[d for d in truth if not truth[d]][:9]]], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.fit(docs, two, F.lit(True))(docs).collect())


def test_toxicity_of_very_long_and_equal_texts(spark):
    rows, labels = toxic_rows(200)
    long = " ".join(["fool you idiot"] * 100_000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, long), (901, long), (902, "a" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))(docs).collect()}
    assert len(got) == 203 and got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
