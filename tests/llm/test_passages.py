"""Substring removal, periodic runs and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tidegraph.llm import periodic, spelling, substrings
from tidegraph.llm.queries import cyclic

WORD = re.compile("[^\x20\x09-\x0d]+")


# -- substrings


def brute_repeats(rows, window=20):
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda r: (r[0], r[1], r[2]))
    first, gone = {}, {}
    for z, i, t in docs:
        w = WORD.findall(t)
        lost = gone[(z, i, t)] = set()
        for a in range(len(w) - window + 1):
            if first.setdefault(tuple(w[a : a + window]), (z, i, t, a)) != (z, i, t, a):
                lost.update(range(a, a + window))
    out = []
    for i, t in rows:
        w, lost = WORD.findall(t or ""), gone[(i is None, i or 0, t or "")]
        out.append((i, len(w), len(lost), " ".join(x for j, x in enumerate(w) if j not in lost)))
    return out


def passages(n=120, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(rng.choice([19, 20, 21, 40, 90]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += [word() for _ in range(rng.randint(0, 30))] if rng.random() < 0.5 else rng.choice(shared)[rng.choice([0, 0, 3]) :]
        rows.append((i, rng.choice([" ", "\t", "  \n"]).join(w)))
    rows += [(n + i, rows[i][1]) for i in range(0, 40, 3)]  # copies
    rows += [rows[5], rows[7]]  # repeated rows
    rows += [(None, rows[9][1]), (None, None), (None, ""), (900, None), (901, " \n "), (902, "x"), (903, " ".join(["same"] * 70))]
    return rows


@pytest.mark.parametrize(("busy", "few"), [(1000, 64), (3, 64), (3, 0), (3, 5)])
def test_substrings_equal_brute_force(spark, monkeypatch, busy, few):
    """With low limits most anchors, and many windows, count as very frequent ones, spread or split."""
    rows = passages()
    rng = random.Random(1)
    rng.shuffle(rows)
    monkeypatch.setattr(substrings, "BUSY", busy)
    monkeypatch.setattr(substrings, "FEW", few)
    monkeypatch.setattr(substrings, "SHARES", 1 << 40)
    docs = spark.createDataFrame([(i, t, 1, "d") for i, t in rows], "doc_id long, text string, n long, anchor string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect())
    assert got == sorted((i if i is not None else -1, *rest) for i, *rest in brute_repeats(rows))
    assert sum(r[2] for r in got) > 500


def test_substrings_of_nothing_and_of_very_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).collect() == []
    rng = random.Random(2)
    base = [str(rng.randrange(5000)) for _ in range(60_000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:30_000], "x", *base[30_000:]])), (3, "z" * 3_000_000)]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].kept, got[3].n_removed) == (0, 60_000, "x", 0)


# -- periodic runs


def brute_runs(w):
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n_, q) for (s, n_), q in best.items())


def brute_collapsed(w, runs):
    lost = {j for s, n, q in runs for j in range(s + q, s + n)}
    return " ".join(x for j, x in enumerate(w) if j not in lost)


def periodic_rows(seed=4):
    rng, rows = random.Random(seed), []
    for i in range(250):
        w = []
        for _ in range(rng.randint(0, 7)):
            p = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
            w += p * rng.randint(1, 9) + p[: rng.randrange(len(p))]
        rows.append((i, rng.choice([" ", " \n"]).join(w)))
    rows += [(900, None), (None, "a a a a a a a"), (901, ""), (902, " \t"), (903, "q " * 500), (903, "q " * 500), (904, "ab ab ab ab ba " * 40), (905, "b " * 5), (906, "b " * 6)]
    return rows


def test_runs_equal_brute_force(spark):
    rows = periodic_rows()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_words long, runs string").repartition(3)
    got = periodic.find_runs(docs).select("doc_id", "n_words", "runs", "collapsed", periodic.longest(periodic.F.col("runs")).alias("best")).collect()
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        r = brute_runs(w)
        want.append((str(i), len(w), r, brute_collapsed(w, r), max(r, key=lambda x: (x[1], -x[0], -x[2])) if r else None))
    key = lambda r: (r[0], r[3])
    assert sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed, tuple(r.best) if r.best else None) for r in got), key=key) == sorted(want, key=key)
    assert sum(len(r[2]) for r in want) > 300
    assert periodic.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.Spec(periods=2)


def test_runs_of_very_long_texts(spark):
    rng = random.Random(6)
    noise = lambda n: [str(rng.randrange(3000)) for _ in range(n)]
    block = noise(9_000)
    w = [*noise(1000), "!", *block * 5, "?", *noise(500), "!", *["x"] * 100_000]
    rows = [(1, " ".join(w)), (2, "x" * 2_000_000)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1001, 45_000, 9_000) in [(s, n, q) for s, n, q in got[1]] and (1001 + 45_000 + 502, 100_000, 1) in got[1] and got[2] == []


def test_cyclic_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(200)] + [(None, "a b"), (7, None), (8, " ")]
    got = cyclic(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, text), r in zip(rows, got, strict=True):
        w, h = WORD.findall(text or ""), zlib.crc32(("" if i is None else str(i)).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        assert WORD.findall(r.text or "") == w
    assert sum(r.text != t for r, (_, t) in zip(got, rows, strict=True)) > 5


# -- spelling variants


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(rows, least=7):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    near = {w: [x for x in words if brute_near(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def spelled(seed=8):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeéÀs") for _ in range(rng.randint(6, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "abcdefg", "bacdefg", "abcdfeg"]
    rows = []
    for i in range(400):
        w = []
        for _ in range(rng.randint(0, 40)):
            x = base[min(int(rng.expovariate(0.3)), len(base) - 1)]
            if rng.random() < 0.08:
                k = rng.randrange(len(x))
                x = rng.choice([x[:k] + x[k + 1 :], x[:k] + "a" + x[k:], x[:k] + rng.choice("abz") + x[k + 1 :]])
            w.append(rng.choice([x, x, x.upper() if x.isascii() else x, x + "!", x + "1" + x]))
        rows.append((i, " ".join(w)))
    rows += [(600 + i, " ".join(["chainaaaa"] * 600 + ["chainaaab"] * 40 + ["chainaacb"] * 3)) for i in range(2)]
    return rows + [(None, rows[3][1]), (None, None), (500, ""), rows[4], rows[4], (501, "y" * 40_000 + " " + "y" * 40_000), (502, "y" * 39_999 + " " + "y" * 39_999)]


def test_spelling_equals_brute_force(spark):
    rows = spelled()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(3)
    words = spelling.word_counts(docs, 7, spelling.drop_letters).where("n > 1")
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.forms(words).collect())
    assert got == brute_forms(rows)
    assert sum(r[1] != "" for r in got) > 50 and any(r[1] not in ("", r[2]) for r in got)
    assert spelling.forms(words.limit(0)).collect() == []


def test_spelling_pairs_are_whole_in_large_anagram_classes(spark):
    from itertools import permutations

    words = sorted({"".join(p) for p in permutations("aabbcc")} | {"".join(p) + "d" for p in permutations("aabbc")} | {"aabbcca", "aabbccÿ"})
    got = sorted((r.word, r.near) for r in spelling.links(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect())
    assert got == sorted((a, b) for a in words for b in words if brute_near(a, b))




# -- the registered queries


def test_queries_equal_brute_force(spark, tmp_path):
    from tidegraph.llm import queries

    rng = random.Random(12)
    rows = [r for r in periodic_rows()[:200] + [(i + 1000, t) for i, t in spelled()[:300]] if r[0] is not None] + [(5000, None), (5001, "")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, t in rows:
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        r = brute_runs(w)
        s, n, q = max(r, key=lambda x: (x[1], -x[0], -x[2])) if r else (None, None, None)
        want[i] = (len(r), s, n, q, 1000 * n // q if r else None, sha("".join(f"{x},{y},{z}\n" for x, y, z in sorted(r, key=lambda x: (x[0], x[2])))), sha(brute_collapsed(w, r)))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)

    got = queries.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == brute_forms(rows)

    got = queries.op11_substring_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, n, m, sha(k)) for i, n, m, k in brute_repeats(rows))
