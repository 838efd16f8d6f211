"""Near-duplicate documents by MinHash bands, odd sketches and exact checks of full shingle sets.

1. Each text becomes its set of word shingles (64-bit hashes), MinHash samples of it, band keys and an odd sketch: a
   bitmap in which each sample flips one bit. The population count of two sketches' XOR tells how many samples differ,
   precisely where the similarity is high.
2. Equal sets are one class; only classes go on. Bands are as many as let a pair at the threshold escape all of them
   once in a million.
3. In each bucket every class is a candidate with the bucket's smallest class. The best of a class's candidates by
   sketch is checked on the full sets.
4. In a bucket whose classes are not in one component by then, classes outside the bucket's largest component are compared
   with all of its classes in tiles of bounded size. Tiles of sketches tell which classes have a plausible partner in
   another component; only these come again, with their full sets, and are compared until connected. So no pair that
   shares a bucket and passes the threshold stays apart, and no task sees a whole group. Of buckets that hold the same
   classes (by 128 bits) one is looked at.

A class is known by its smallest id and its set together, so texts of one id are classes of their own. The rows of a node
with very many links, and of a set with very many copies, are spread over all tasks.

Nulls: a null text is empty; an empty set has no links. Rows with a null id take part and come last in the order of ids: a
component without any id has none, and the row with the smallest set is kept. Repeated rows share an id and a component.
Rows with one id and different texts are compared each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.components import components, hot_keys, join_spread, roots
from tidegraph.llm.wordtable import slices, split_blanks
from tidegraph.scratch import materialize

SKETCH_BITS = 512
FILTER_BITS = 1 << 27  # at most
TILE = 256


@dataclass(frozen=True)
class Spec:
    """Shingle length in words, threshold in percent, rows of a band; escape: the odds of missing a pair at the threshold."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    escape: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.escape) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_flips(self) -> int:
        """XOR population count beyond which a pair is dissimilar, five deviations of samples and bits off the threshold."""
        t, m = self.percent / 100, SKETCH_BITS
        low = max(0.0, t - 5 * math.sqrt(t * (1 - t) / self.samples))
        p = (1 - (1 - 2 / m) ** (2 * self.samples * (1 - low))) / 2
        return math.ceil(m * p + 3 * math.sqrt(m * p * (1 - p)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each text in a binary column without nulls the sorted distinct 64-bit hashes of its word shingles; fewer words
    make one shingle, none an empty set. Each distinct word of a stretch of texts is hashed once."""
    for some in slices(texts):
        w = split_blanks(some)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, w.table), np.uint64, len(w.table))[w.codes]
        whole = _rolled(h, words)
        for start, size in zip(w.starts.tolist(), w.sizes.tolist(), strict=True):
            s = whole[start : start + size - words + 1] if size >= words else _rolled(h[start : start + size], size)
            s = np.sort(s)
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """shingle_sets() of one text."""
    return next(shingle_sets(pa.array([text], pa.binary()), words))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """The hashes of each n successive words of one or more."""
    if not n or len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return _mix(out)


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def minhash(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(out, (a[:, None] * s[None, at : at + 1024]).min(axis=1), out=out)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Of each row of samples SKETCH_BITS bits as 64-bit words: the parity of how many (place, sample) fall on each."""
    n = len(samples)
    bit = _mix(samples + np.arange(samples.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    at = bit.astype(np.int64) + SKETCH_BITS * np.arange(n)[:, None]
    odd = (np.bincount(at.ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64).reshape(n, -1)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """odd_sketches() of one row."""
    return odd_sketches(samples[None, :])[0]


def band_keys(samples: np.ndarray, spec: Spec) -> np.ndarray:
    """Of each row of samples the key of each band."""
    key = np.tile(np.arange(spec.bands, dtype=np.uint64), (len(samples), 1))
    for i in range(spec.rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, i :: spec.rows])
    return key


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def set_name(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def rep_of(doc_id: int | None, name: bytes) -> bytes:
    """A class's key, in the order of ids: whether there is none, the id, the set."""
    return (b"\1" + bytes(8) if doc_id is None else b"\0" + (doc_id + (1 << 63)).to_bytes(8, "big")) + name


def rep_column(doc_id: Column, name: Column) -> Column:
    shifted = F.unhex(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(doc_id.isNull(), F.lit(b"\1" + bytes(8))).otherwise(F.concat(F.lit(b"\0"), shifted)), name)


def id_of(rep: Column) -> Column:
    digits = F.conv(F.hex(F.substring(rep, 2, 8)), 16, 10).cast("decimal(20,0)")
    return F.when(F.substring(rep, 1, 1) == F.lit(b"\0"), (digits - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long"))


def signatures(docs: DataFrame, spec: Spec) -> DataFrame:
    """docs(doc_id, ..., raw binary) to (doc_id, ..., n_shingles, set_id, bands, sketch)."""
    keep = [c for c in docs.columns if c != "raw"]

    def longs(rows: np.ndarray, full: np.ndarray) -> pa.Array:
        """A list for each place of full, null where it is false."""
        size = np.where(full, rows.shape[1], 0)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.view(np.int64).ravel()), mask=pa.array(~full))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _coefficients(spec.samples)
        for b in batches:
            size, ids, m = [], [], []
            for s in shingle_sets(b.column("raw"), spec.words):
                size.append(len(s))
                ids.append(set_name(s) if len(s) else None)
                if len(s):
                    m.append(minhash(s, a))
            m = np.array(m, np.uint64).reshape(-1, spec.samples)
            full = np.array(size, np.int64) > 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), longs(band_keys(m, spec), full), longs(odd_sketches(m), full)], [*keep, "n_shingles", "set_id", "bands", "sketch"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "raw").mapInArrow(sign, schema + "n_shingles long, set_id binary, bands array<long>, sketch array<long>")


def _bitmap(ids: DataFrame, bits: int) -> bytes:
    """The bits of the hashes of ids(rep): a filter of bounded size that lets nothing wanted be dropped."""
    h = F.pmod(F.xxhash64(id_of(F.col("rep"))), F.lit(bits))
    rows = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = bytearray(bits // 8 + 8192)
    for r in rows:  # 32768 bits each; the first bucket number stands for h = 0 alone in some versions
        at = max(0, r.k) * 4096
        out[at : at + 4096] = bytes(x | y for x, y in zip(out[at : at + 4096], bytes(r.bits), strict=False))
    return bytes(out)


def candidate_sets(docs: DataFrame, ids: DataFrame, spec: Spec) -> DataFrame:
    """(rep, shingles binary) of the classes in ids(rep), computed anew from the texts of the documents they are named for."""
    size = min(FILTER_BITS, 1 << max(18, (16 * ids.count()).bit_length()))
    numbered = docs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    numbered = numbered.withColumns({"k": F.bitmap_bucket_number("h"), "p": F.bitmap_bit_position("h")})
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(ids, size))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for b in batches:
            k, p = (b.column(c).to_pylist() for c in ("k", "p"))
            some = b.filter(pa.array([held[max(0, i) * 4096 + (j >> 3)] >> (j & 7) & 1 == 1 for i, j in zip(k, p, strict=True)], pa.bool_()))
            rep, out = [], []
            for d, s in zip(some.column("doc_id").to_pylist(), shingle_sets(some.column("raw"), spec.words), strict=True):
                rep.append(rep_of(d, set_name(s)))
                out.append(s.tobytes())
            yield pa.record_batch({"rep": pa.array(rep, pa.binary()), "shingles": pa.array(out, pa.binary())})

    found = numbered.mapInArrow(sets, "rep binary, shingles binary")
    return found.join(ids, "rep", "left_semi")


def _checked(pairs: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """The pairs(a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            ok = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), spec.percent) for p, q in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    pairs = materialize(pairs, "candidates")
    hot = hot_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), "b", pairs.count())  # a leader of very many
    full = join_spread(pairs.join(x, "a"), y, "b", "a", hot)
    return full.select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def _by_tile(rows: DataFrame, look: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """look() at each tile of rows(key, mb, rb, ...), a task's tiles one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            at = [table.column(c).to_numpy() for c in ("key", "mb", "rb")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
                yield look(table.slice(i, j - i))
            held = table.slice(int(cuts[-1])) if len(cuts) else table
        if held is not None and len(held):
            yield look(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for b in run(batches):
            if len(b):
                some.append(b)
            if len(some) == 64:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some = []
        if some:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "mb", "rb").sortWithinPartitions("key", "mb", "rb").mapInArrow(joined, schema)


def _near(tile: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile the places of its rest and of its members, their components as numbers, and the flips of each such pair;
    flips of pairs within a component, or of too many flips, are -1."""
    rest = tile.column("rest").to_numpy()
    r, m = np.flatnonzero(rest), np.flatnonzero(~rest)
    comp = tile.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    sketch = tile.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(tile), -1)
    flips = np.zeros((len(r), len(m)), np.int64)
    for i in range(sketch.shape[1]):
        flips += np.bitwise_count(sketch[r, i][:, None] ^ sketch[m, i][None, :])
    flips[(flips > most) | (comp[r][:, None] == comp[m][None, :])] = -1
    return r, m, comp[r], comp[m], flips


def _plausible(rows: DataFrame, spec: Spec) -> DataFrame:
    """The rows(key, mb, rb, rest, rep, comp, sketch) that have a plausible partner in another component within their tile."""
    most = spec.most_flips

    def look(tile: pa.Table) -> pa.RecordBatch:
        r, m, _, _, flips = _near(tile, most)
        near = flips >= 0
        at = np.sort(np.concatenate([r[near.any(axis=1)], m[near.any(axis=0)]]))
        return pa.RecordBatch.from_arrays([c.combine_chunks().take(pa.array(at)) for c in tile.columns], schema=tile.schema)

    return _by_tile(rows, look, "key long, mb int, rb int, rest boolean, rep binary, comp binary, sketch array<long>")


def _links(rows: DataFrame, spec: Spec) -> DataFrame:
    """The same rows with shingles, the full sets, to the links(a, b) between components, each confirmed on two full sets."""
    most, percent = spec.most_flips, spec.percent

    def look(tile: pa.Table) -> pa.RecordBatch:
        r, m, rc, mc, flips = _near(tile, most)
        comp, sets = tile.column("comp"), tile.column("shingles")
        full = [np.frombuffer(s.as_buffer(), np.uint64) for s in sets]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        a, b = [], []
        for i in range(len(r)):
            near = np.flatnonzero(flips[i] >= 0)
            for j in near[np.argsort(flips[i][near], kind="stable")].tolist():
                u, v = find(int(rc[i])), find(int(mc[j]))
                if u != v and similar(full[r[i]], full[m[j]], percent):
                    root[u] = v
                    a.append(comp[int(r[i])].as_py())
                    b.append(comp[int(m[j])].as_py())
        return pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return _by_tile(rows, look, "a binary, b binary")


def near_duplicates(docs: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, the columns carry, n_shingles, component_id (the smallest id reachable), kept
    (whether its id is that one), component (the key of the class that names the component), first (whether its class is
    that one; both null and true for an empty set)."""
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    signed = materialize(signatures(raw, spec), "signatures")
    raw = raw.select("doc_id", "raw")
    able = signed.where("set_id is not null")
    classes = able.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("bands", "sketch")).alias("m"))
    classes = materialize(classes.select("set_id", rep_column(F.col("doc_id"), F.col("set_id")).alias("rep"), "m.bands", "m.sketch"), "classes")

    buckets = classes.select("rep", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count("*").alias("n")).where("leader <> last")
    leaders = materialize(leaders.select("key", "leader", "n"), "leaders")
    hot = hot_keys(leaders, "key", classes.count() * spec.bands)
    stars = materialize(join_spread(buckets, leaders.drop("n"), "key", "rep", hot).select("key", "rep", "leader"), "stars")
    shared = materialize(stars.select("rep").distinct(), "shared")
    sets = materialize(candidate_sets(raw, shared, spec).groupBy("rep").agg(F.first("shingles").alias("shingles")), "sets")

    sketches = classes.select("rep", "sketch")
    pairs = materialize(stars.where("rep <> leader").select("rep", "leader").distinct(), "pairs")
    hot = hot_keys(pairs.groupBy("leader").agg(F.count("*").alias("n")), "leader", pairs.count())
    pairs = join_spread(pairs.join(sketches, "rep"), sketches.select(F.col("rep").alias("leader"), F.col("sketch").alias("other")), "leader", "rep", hot)
    flips = F.aggregate(F.zip_with("sketch", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    best = pairs.withColumn("flips", flips).where(F.col("flips") <= spec.most_flips)
    best = best.groupBy("rep").agg(F.min_by("leader", F.struct("flips", "leader")).alias("leader"))
    first = materialize(_checked(best.select(F.col("rep").alias("a"), F.col("leader").alias("b")), sets, spec), "links")

    found = roots(first)
    placed = stars.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = materialize(placed, "placed")
    names = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in range(2)]
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), *names)
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("main"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    sizes = sizes.where(F.col("all") > F.col("main.n")).groupBy("all", "x0", "x1").agg(F.min(F.struct("key", "main")).alias("one"))  # buckets of the same classes
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = sizes.select("one.key", "all", F.col("one.main.comp").alias("main"), tiles(F.col("all")).alias("mbs"), tiles(F.col("all") - F.col("one.main.n")).alias("rbs"))
    sizes = materialize(sizes, "sizes")
    hot = hot_keys(sizes.select("key", F.col("all").alias("n")), "key", placed.count())
    rows = join_spread(placed, sizes.drop("all"), "key", "rep", hot).join(sketches, "rep")
    spread = F.xxhash64("rep")
    as_member = rows.withColumns({"mb": F.pmod(spread, F.col("mbs")).cast("int"), "rb": F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)), "rest": F.lit(False)})
    as_rest = rows.where("comp <> main").withColumns({"rb": F.pmod(spread, F.col("rbs")).cast("int"), "mb": F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)), "rest": F.lit(True)})
    columns = ["key", "mb", "rb", "rest", "rep", "comp", "sketch"]
    plausible = materialize(_plausible(as_member.select(columns).unionByName(as_rest.select(columns)), spec), "plausible")
    second = materialize(_links(plausible.join(sets, "rep").select(*columns, "shingles"), spec), "links")

    of_class = classes.select("set_id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    if not second.isEmpty():
        of_class = materialize(of_class, "of_class")
        merged = components(second).select(F.col("node").alias("component"), F.col("component").alias("all"))
        hot = hot_keys(of_class.groupBy("component").agg(F.count("*").alias("n")), "component", of_class.count())
        of_class = join_spread(of_class, merged, "component", "set_id", hot, "left").select("set_id", F.coalesce("all", "component").alias("component"))
    copies = signed.groupBy("set_id").agg(F.count("*").alias("n"))
    out = signed.select("doc_id", *carry, "n_shingles", "set_id")
    out = join_spread(out.withColumn("spread", F.monotonically_increasing_id()), of_class, "set_id", "spread", hot_keys(copies, "set_id", signed.count()), "left")
    own = F.when(F.col("set_id").isNotNull(), rep_column(F.col("doc_id"), F.col("set_id")))
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(id_of(F.col("component")))
    first = F.coalesce(own == F.col("component"), F.lit(True))
    return out.select("doc_id", *carry, "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, first).alias("kept"), "component", first.alias("first"))


#: DuckDB SQL for near_duplicates() over documents with 3 words and 85 percent.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
      ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS s FROM w),
c AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM g) GROUP BY s HAVING len(s) > 0),
x AS (SELECT rep, len(s) AS n, unnest(s) AS sh FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.sh = b.sh AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, u) AS (SELECT rep, rep FROM c UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
k AS (SELECT v, min(u) AS comp FROM r GROUP BY v),
m AS (SELECT c.s, k.comp FROM c JOIN k ON c.rep = k.v)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(m.comp, g.doc_id) AS component_id, g.doc_id = coalesce(m.comp, g.doc_id) AS kept
FROM g LEFT JOIN m ON list_sort(g.s) = m.s
"""
