"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies. A count-min sketch of fixed size gathers, over all
   documents, how many hold each shingle (five words); idf = ln(1 + N / df). Its estimates are never too
   low, and too high by about N * (mean distinct shingles a document) / 2**SKETCH_BITS: for documents of 350
   words by N / 750, so that no idf is above 6.6 there. That is its only bound.
2. Signatures. ROWS * BANDS consistent weighted samples (Ioffe's improved
   scheme) of tf * idf: two documents share a sample with the probability of
   their weighted Jaccard similarity. ROWS * PLAIN more samples are taken with all weights alike, and are shared
   with the probability of the plain Jaccard similarity.
3. Candidates are all pairs of texts that share a band, however many texts share it. In
   a bucket of up to SMALL texts they are listed. Larger buckets are compared as a
   grid: their texts are dealt by hash into blocks of about BLOCK texts, and every
   block is held against every block, so no task holds more than two blocks. Larger buckets
   that hang together are one grid if that costs less than a grid each. A
   grid gives no list of links, which grows with the square of a group, but
   each text's number of links and a forest that spans them.
4. Verification. Both whole texts' weighted shingle sets give the weighted
   Jaccard similarity. A pair is a link if that is at least SIMILARITY, or, unless plain=False is asked for, if the
   plain one is: in a family of thousands the shared shingles have low idf and the few edited ones a high one, so that weights alone
   hide plain copies. With plain=False the plain bands and the plain measure are left out.
5. Classes are the connected components of the links.

Exact copies are put together first, by a digest of the text, and are members of their
text's class, not pairs. Two texts at weighted similarity 0.8 share no weighted band with probability
(1 - 0.8**3)**16, about 1e-5; at plain similarity 0.8 no plain band with (1 - 0.8**3)**12, about 2e-4.

Nulls and odd input: texts without words (null, empty, blank) are in no class
but their own, whose id is their doc_id. A text of under five words is one
shingle. A class has the least doc_id of its members (null only if all are null). Repeated rows
are members of one class. Whole texts are sampled, of any length. Extra columns pass through `drop`, and
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.components import components
from quillmark.llm.textkit import U, mix, shingles
from quillmark.session import bounded_batches, written

WORDS, SIMILARITY = 5, 0.8
BANDS, PLAIN, ROWS, SMALL = 16, 12, 3, 32
#: Texts and characters of a block of a grid, about, and shingles that a block is compared by at a time.
BLOCK, BLOCK_CHARS, COLUMNS = 512, 1 << 22, 4096
SKETCH_ROWS, SKETCH_BITS = 2, 18
_K, _ALL = BANDS * ROWS, (BANDS + PLAIN) * ROWS
_RNG = np.random.default_rng(20240131)
#: Gamma(2, 1) numbers for 16 random bits each; a key and an odd factor for each weighted sample and each two plain ones.
_R = _RNG.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LNC = np.log(_RNG.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_HALVES = PLAIN * ROWS // 2
_KEYS, _FACTORS = ((_RNG.integers(0, (1 << 64) - 1, _K + _HALVES, dtype=np.uint64, endpoint=True) | U(1))[:, None] for _ in range(2))


def has_words() -> Column:
    """Whether a text has words; null or false for others. Only the start of a text is looked at."""
    return F.ltrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != ""


def text_key() -> Column:
    """Digest of a text that has words; null for others."""
    return F.when(has_words(), F.unhex(F.md5(F.col("text").cast("binary"))))


def _slots(x: np.ndarray) -> list[np.ndarray]:
    """Places of shingles in each row of the sketch."""
    return [((x >> U(i * 20)) & U((1 << SKETCH_BITS) - 1)).astype(np.int64) for i in range(SKETCH_ROWS)]


class Sketch:
    """Document frequencies of shingles; estimates are never too low."""

    def __init__(self, data: bytes | None = None, n: int = 0):
        self.counts = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64) if data is None else np.frombuffer(zlib.decompress(data), np.int64).reshape(SKETCH_ROWS, -1).copy()
        self.n = n

    def add(self, shingle_sets: list[np.ndarray]) -> None:
        x = np.concatenate(shingle_sets)
        for row, at in zip(self.counts, _slots(x), strict=True):
            row += np.bincount(at, minlength=row.size)
        self.n += len(shingle_sets)

    def packed(self) -> bytes:
        return zlib.compress(self.counts.tobytes(), 1)

    def idf(self, x: np.ndarray) -> np.ndarray:
        df = np.maximum(1, np.min([row[at] for row, at in zip(self.counts, _slots(x), strict=True)], axis=0))
        return np.log1p(self.n / df)


_SKETCH_SCHEMA = "n long, counts binary"


def _sketched(n: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["n", "counts"])


def _sketch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = Sketch()
    for b in batches:
        held, size = [], 0
        for text in b.column("text").to_pylist():
            x = shingles(text or "", WORDS)[0]
            if x.size:
                held.append(x)
                size += x.size
            if size > 1 << 18:
                sketch.add(held)
                held, size = [], 0
        if held:
            sketch.add(held)
    if sketch.n:
        yield _sketched(sketch.n, sketch.packed())


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Sketch()
    for b in batches:
        for n, data in zip(b.column("n").to_pylist(), b.column("counts").to_pylist(), strict=True):
            total.counts += Sketch(data).counts
            total.n += n
    if total.n:
        yield _sketched(total.n, total.packed())


def document_frequencies(docs: DataFrame) -> Sketch:
    """The sketch of all documents, merged in two levels; its size is fixed."""
    parts = written(docs.select("text").mapInArrow(_sketch_task, _SKETCH_SCHEMA), "sketch")
    some = max(1, round(parts.count() ** 0.5))
    total = Sketch()
    for n, data in parts.repartition(some).mapInArrow(_merge_task, _SKETCH_SCHEMA).toLocalIterator():
        total.counts += Sketch(bytes(data)).counts
        total.n += n
    return total


def _draws(x: np.ndarray, keys: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """64 random bits for each key (rows) and shingle; shingles are mixed already, so one product with a factor of the key's own is enough."""
    z = x[None, :] ^ keys
    z *= factors
    return z


def signature(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 32-bit sample for each key. Weighted: the shingle of least ln a = ln c - r (t - beta), t = ceil(ln w / r + beta), with t. Plain: the least draw."""
    lnw = np.log(weights).astype(np.float32)
    best, chosen, level, k = np.full(_K, np.inf, np.float32), np.zeros(_K, np.int64), np.zeros(_K, np.int64), np.arange(_K)
    plain = np.full((_HALVES, 2), (1 << 32) - 1, np.uint32)
    for at in range(0, x.size, 512):
        own = x[at : at + 512]
        # 16 bits each for r, c and beta, the lowest left out
        bits = _draws(own, _KEYS[:_K], _FACTORS[:_K]).view("<u2").reshape(_K, own.size, 4)
        r = _R.take(bits[:, :, 3])
        beta = bits[:, :, 1] * np.float32(1 / 65536)
        t = lnw[None, at : at + 512] / r
        t += beta
        np.ceil(t, out=t)
        np.subtract(t, beta, out=beta)
        beta *= r
        ln_a = _LNC.take(bits[:, :, 2])
        ln_a -= beta
        j = ln_a.argmin(axis=1)
        better = ln_a[k, j] < best
        best, chosen, level = (np.where(better, new, old) for new, old in ((ln_a[k, j], best), (j + at, chosen), (t[k, j].astype(np.int64), level)))
        # each draw serves two plain samples, by its halves
        halves = _draws(own, _KEYS[_K:], _FACTORS[_K:]).view("<u4").reshape(_HALVES, own.size, 2)
        for i in range(2):
            np.minimum(plain[:, i], halves[:, :, i].min(axis=1), out=plain[:, i])
    out = mix(x[chosen] + level.astype(U) * U(0xD6E8FEB86659FD93))
    return np.concatenate(((out >> U(32)).astype("<u4"), plain.ravel()))


def weighted(text: str, sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their tf * idf."""
    x, tf = shingles(text, WORDS)
    return x, tf * sketch.idf(x)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], plain: bool = True) -> float:
    """The weighted Jaccard similarity, or the plain one if that is larger and asked for."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not i.size:
        return 0.0
    common = np.minimum(a[1][i], b[1][j]).sum()
    both = float(common / (a[1].sum() + b[1].sum() - common))
    return max(both, i.size / (a[0].size + b[0].size - i.size)) if plain else both


def signatures(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """doc_id, v (text key), sig of every document with words."""
    shared = docs.sparkSession.sparkContext.broadcast((sketch.packed(), sketch.n))  # of fixed size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, recent = Sketch(*shared.value), {}
        for b in batches:
            keys, out = b.column("v").to_pylist(), []
            for v, text in zip(keys, b.column("text").to_pylist(), strict=True):
                if v not in recent:
                    if len(recent) > 2000:
                        recent.clear()
                    recent[v] = signature(*weighted(text, own)).tobytes()
                out.append(recent[v])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("v"), pa.array(out, pa.binary())], ["doc_id", "v", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("v")).where(has_words())
    return rows.mapInArrow(task, "doc_id long, v binary, sig binary")


def _band(i: int) -> Column:
    return F.substring(F.col("sig"), 4 * ROWS * i + 1, 4 * ROWS)


def _pairs(buckets: DataFrame) -> DataFrame:
    """All pairs of the texts in each bucket of at most SMALL."""
    return buckets.select(
        F.explode(F.expr("flatten(transform(vs, (x, i) -> transform(slice(vs, i + 2, size(vs)), y -> struct(x AS a, y AS b))))")).alias("p")
    ).select("p.a", "p.b")


def candidates(texts: DataFrame, plain: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs a < b of text keys that share a bucket of at most SMALL and no larger one; (v, band, key, n) of the larger buckets, or None.

    texts has v and sig, one row per text.
    """
    keyed = texts.select("v", F.posexplode(F.array(*[F.xxhash64(F.lit(i), _band(i)) for i in range(BANDS + PLAIN if plain else BANDS)])).alias("band", "key"))
    # written before it is joined, so that the join shuffles both sides anew and can split hot buckets
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    members = written(keyed.join(sizes, "key").select("v", "band", "key", "n"), "buckets")
    found = _pairs(members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("v")).alias("vs"))).distinct()
    large = members.where(F.col("n") > SMALL)
    if not large.take(1):
        return written(found, "pairs"), None
    held = large.groupBy("v").agg(F.collect_list("key").alias("keys"))
    for side in ("a", "b"):
        found = found.join(held.select(F.col("v").alias(side), F.col("keys").alias("keys_" + side)), side, "left")
    found = found.where(~F.coalesce(F.arrays_overlap("keys_a", "keys_b"), F.lit(False)))
    return written(found.select("a", "b"), "pairs"), large


def first_texts(docs: DataFrame, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """v, text of the given keys, from one document each."""
    needed = texts.join(keys.distinct(), "v", "left_semi").select("v", F.substring("v", -16, 16).alias("digest"), F.col("doc_id").alias("first"))
    keyed = docs.select("doc_id", "text", text_key().alias("own")).where(has_words())
    one = keyed.join(needed, (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("v", "text")
    return written(one.dropDuplicates(["v"]), "texts")


def links(one: DataFrame, pairs: DataFrame, sketch: Sketch, plain: bool = True) -> DataFrame:
    """a, b, similarity of the candidate pairs that are at least SIMILARITY; one has v and text."""
    shared = one.sparkSession.sparkContext.broadcast((sketch.packed(), sketch.n))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, recent = Sketch(*shared.value), {}

        def parsed(v: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if v not in recent:
                for old in list(islice(recent, 64 if len(recent) > 512 else 0)):
                    del recent[old]
                recent[v] = weighted(text, own)
            return recent[v]

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            out = [similarity(parsed(a, x), parsed(c, y), plain) for a, c, x, y in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    both = pairs.join(one.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a").join(one.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
    return written(both.mapInArrow(task, "a binary, b binary, similarity double").where(F.col("similarity") >= SIMILARITY).distinct(), "links")


def similarities(left: list[str], right: list[str], sketch: Sketch, plain: bool = True) -> np.ndarray:
    """`similarity` of every text of one list to every text of the other.

    A shingle that a text has tf times is tf units of its idf, so what two texts have in common is a product of matrices of units.
    """
    units, rows, totals, sizes = [], [], np.zeros(len(left) + len(right)), np.zeros(len(left) + len(right))
    for i, text in enumerate(left + right):
        x, tf = shingles(text, WORDS)
        totals[i], sizes[i] = (tf * sketch.idf(x)).sum(), x.size
        nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        units.append(np.stack([np.repeat(x, tf), nth.astype(U)], axis=1))
        rows.append(np.full(nth.size, i))
    unit, row = np.concatenate(units), np.concatenate(rows)
    order = np.lexsort((unit[:, 1], unit[:, 0]))
    unit, row = unit[order], row[order]
    column = np.cumsum(np.concatenate(([0], (unit[1:] != unit[:-1]).any(axis=1)))) if row.size else row
    n = int(column[-1]) + 1 if row.size else 0
    on_left, on_right = (np.bincount(column[side], minlength=n) > 0 for side in (row < len(left), row >= len(left)))
    both = (on_left & on_right)[column]
    unit, row, column = unit[both], row[both], np.unique(column[both], return_inverse=True)[1]
    idf, first = sketch.idf(unit[:, 0]), unit[:, 1] == 0
    common, shared = (np.zeros((len(left), len(right))) for _ in range(2))
    starts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 if column.size else 0, COLUMNS))
    for at, end in zip(starts, [*starts[1:], column.size], strict=True):
        c, r, f = column[at:end] - column[at], row[at:end], first[at:end]
        has = np.zeros((len(left) + len(right), int(c[-1]) + 1), np.float32)
        has[r, c] = 1
        weight, distinct = np.zeros(has.shape[1], np.float32), np.zeros(has.shape[1], np.float32)
        weight[c], distinct[c] = idf[at:end], f
        a, b = has[: len(left)], has[len(left) :].T
        common += (a * weight) @ b
        if plain:
            shared += (a * distinct) @ b
    split = len(left)
    both = common / (totals[:split, None] + totals[None, split:] - common)
    return np.maximum(both, shared / (sizes[:split, None] + sizes[None, split:] - shared)) if plain else both


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a symmetric matrix of links."""
    out, seen = [], np.zeros(linked.shape[0], bool)
    for start in range(linked.shape[0]):
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            u = stack.pop()
            new = np.flatnonzero(linked[u] & ~seen)
            seen[new] = True
            out += [(u, int(x)) for x in new]
            stack += new.tolist()
    return out


def compared(one: DataFrame, large: DataFrame, sketch: Sketch, plain: bool = True) -> DataFrame:
    """Of all pairs that share a large bucket: v, null, number of links; and v, other, 0 of a forest that spans the links.

    Every pair is compared once: in the one grid of its buckets, or in the first bucket it shares.
    """
    shared = one.sparkSession.sparkContext.broadcast((sketch.packed(), sketch.n))
    cache: list[Sketch] = []

    def task(group: pa.Table) -> pa.Table:
        if not cache:
            cache.append(Sketch(*shared.value))
        cols = group.to_pydict()
        p, q, band = cols["p"][0], cols["q"][0], cols["band"][0]
        blocks = [[i for i, x in enumerate(cols["block"]) if x == side] for side in (p, q)]
        keys = [np.array([cols["keys"][i] for i in x], np.int64).reshape(-1, BANDS + PLAIN) for x in blocks]
        wanted = np.zeros((len(blocks[0]), len(blocks[1])), bool)
        for i in range(BANDS + PLAIN) if band is None else range(band):
            wanted |= (keys[0][:, i, None] == keys[1][None, :, i]) & (keys[0][:, i, None] != 0)
        if band is not None:
            wanted = ~wanted
        if p == q:
            wanted = np.triu(wanted, 1)
        at, to = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        out: list[tuple[bytes, bytes | None, int]] = []
        if at.size:
            left, right = [blocks[0][i] for i in at], [blocks[1][i] for i in to]
            linked = wanted[np.ix_(at, to)] & (similarities([cols["text"][i] for i in left], [cols["text"][i] for i in right], cache[0], plain) >= SIMILARITY)
            members = sorted({*left, *right})
            place = {x: i for i, x in enumerate(members)}
            whole = np.zeros((len(members), len(members)), bool)
            whole[np.ix_([place[x] for x in left], [place[x] for x in right])] = linked
            whole |= whole.T
            v = [cols["v"][x] for x in members]
            out = [(v[i], None, int(n)) for i, n in enumerate(whole.sum(axis=1)) if n] + [(v[i], v[j], 0) for i, j in _forest(whole)]
        return pa.table({"v": pa.array([x[0] for x in out], pa.binary()), "other": pa.array([x[1] for x in out], pa.binary()), "n": pa.array([x[2] for x in out], pa.int64())})

    least = written(large.groupBy("key").agg(F.min("v").alias("b")), "least")
    roots = components(large.join(least, "key").select(F.col("v").alias("a"), "b"))
    at_band = [F.coalesce(F.max(F.when(F.col("band") == i, F.col("key"))), F.lit(0)) for i in range(BANDS + PLAIN)]
    texts = written(large.groupBy("v").agg(F.array(*at_band).alias("keys"), F.sum("n").alias("cost")).join(roots, "v"), "held")
    cost = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    texts = texts.drop("cost").join(cost.select("root", (F.col("n") * F.col("n") <= F.col("cost")).alias("together")), "root").join(one, "v")
    together = texts.where("together").select("v", "text", "keys", F.lit(None).cast("int").alias("band"), F.base64("root").alias("cell"))
    apart = texts.where("NOT together").join(large.select("v", "band", "key"), "v").select("v", "text", "keys", "band", F.col("key").cast("string").alias("cell"))
    rows = together.union(apart)
    blocks = rows.groupBy("cell").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = dealt.select("cell", F.least("block", "against").alias("p"), F.greatest("block", "against").alias("q"), "block", "band", "v", "keys", "text")
    return written(grid.groupBy("cell", "p", "q").applyInArrow(task, "v binary, other binary, n long"), "compared")


def vertex(doc_id: Column, digest: Column) -> Column:
    """25 bytes that sort like doc_id (null last), then digest: the least of a class tells its class id."""
    place = F.unhex(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.when(doc_id.isNull(), F.concat(F.unhex(F.lit("01" + "00" * 8)), digest)).otherwise(F.concat(F.unhex(F.lit("00")), place, digest))


def vertex_id(v: Column) -> Column:
    """The doc_id of a vertex."""
    return F.when(F.hex(F.substring(v, 1, 1)) == "00", F.conv(F.hex(F.substring(v, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63))))


def classes(docs: DataFrame, plain: bool = True) -> DataFrame:
    """v (digest), class_id, n_links of every text that has words."""
    bounded_batches(docs.sparkSession)
    sketch = document_frequencies(docs)
    signed = written(signatures(docs, sketch), "signatures")
    texts = signed.groupBy(F.col("v").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig"))
    texts = written(texts.select(vertex(F.col("doc_id"), F.col("digest")).alias("v"), "doc_id", "sig"), "distinct")
    pairs, large = candidates(texts.select("v", "sig"), plain)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("v"))
    one = first_texts(docs, texts, keys if large is None else keys.union(large.select("v")))
    found = links(one, pairs, sketch, plain)
    edges, counts = found.select("a", "b"), found.select(F.explode(F.array("a", "b")).alias("v"), F.lit(1).cast("long").alias("n"))
    if large is not None:
        more = compared(one, large, sketch, plain)
        edges = edges.union(more.where("other IS NOT NULL").select("v", "other"))
        counts = counts.union(more.where("other IS NULL").select("v", "n"))
    roots = components(edges)
    degree = counts.groupBy("v").agg(F.sum("n").alias("n_links"))
    own = texts.select("v").join(roots, "v", "left").join(degree, "v", "left")
    # the root is the least vertex of its class, so the class id needs no join by root
    return written(own.select(F.substring("v", -16, 16).alias("v"), vertex_id(F.coalesce("root", "v")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")


def report(docs: DataFrame, plain: bool = True) -> DataFrame:
    """One row per document: its class, the number of other texts that its text is linked to, and whether it is the class's first document."""
    found = classes(docs, plain)
    keyed = docs.select("doc_id", text_key().alias("v"))
    out = keyed.join(found, "v", "left").select("doc_id", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


P = "__qm_"


def drop(docs: DataFrame, plain: bool = True) -> DataFrame:
    """docs with one row of each class: that of the least doc_id. Texts without words stay."""
    found = classes(docs, plain)
    rows = docs.withColumn(P + "v", text_key()).join(found.select(F.col("v").alias(P + "v"), F.col("class_id").alias(P + "class")), P + "v", "left")
    alone = F.col(P + "v").isNull()
    first = rows.where(alone | F.col("doc_id").eqNullSafe(F.col(P + "class")))
    # of rows that repeat the first doc_id, one stays; there are as many as such repeats, never a class
    single = first.where(~alone).dropDuplicates([P + "class"])
    return first.where(alone).unionByName(single).select(*docs.columns)
