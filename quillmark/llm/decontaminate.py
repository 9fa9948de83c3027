"""Benchmark decontamination by greedy string tiling.

A seed is MIN_MATCH consecutive words shared by a document and a benchmark item.
For pairs with enough seeds to reach the threshold, tiles are laid: with search lengths from long
to short, Karp-Rabin hashes of all unmarked runs of that length are compared, matches are
extended to their maximum, and the longest are marked first; what a mark leaves of a match waits for
its turn by its length. Marked words belong to one tile on either side. The share of an item's words under tiles is
its coverage, in whatever order its passages appear. A document of coverage at
least THRESHOLD leaks the item.

Documents are mapped, never shuffled: the seeds of the benchmark go to all
tasks in blocks of at most BLOCK_SEEDS seeds (about 60 MB), one pass over the
documents for each block, so a benchmark of any size is held against all documents.
Words are runs of letters and digits in lower case.

Nulls and odd input: null texts have no words. Items under MIN_MATCH words have no seed, as nearly every document holds
some such words, and cannot be searched; `unsearched` lists them. Items without id are reported with null. Repeated
documents are judged alike; of repeated items each row is an item. Whole texts of any length are searched. Extra columns
pass through `drop`; empty tables give no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.textkit import hash_words, rolling
from quillmark.session import bounded_batches

MIN_MATCH, THRESHOLD = 5, 0.5
BLOCK_SEEDS = 2_000_000
LENGTHS = (160, 80, 40, 20, 10, MIN_MATCH)
BETWEEN = re.compile(r"[\W_]+")


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    return hash_words(BETWEEN.sub(" ", (text or "").lower()))[0]


def _runs(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n words of which none is marked."""
    if marked.size < n:
        return np.empty(0, np.int64)
    ahead = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(ahead[n:] == ahead[:-n])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, length) of tiles: always the longest match of unmarked words next, of equals the first in doc, then in item."""
    free_doc, free_item = np.zeros(doc.size, bool), np.zeros(item.size, bool)  # True where marked
    out: list[tuple[int, int, int]] = []
    for n in [x for x in LENGTHS if x > least] + [least]:
        # all matches of n words and more; shorter ones are left to the next search length
        in_doc, in_item = _runs(free_doc, n), _runs(free_item, n)
        if not in_doc.size or not in_item.size:
            continue
        by_item = rolling(item, n)[in_item]
        order = np.argsort(by_item, kind="stable")
        by_item, in_item = by_item[order], in_item[order]
        by_doc = rolling(doc, n)[in_doc]
        low, high = np.searchsorted(by_item, by_doc), np.searchsorted(by_item, by_doc, "right")
        queue: list[tuple[int, int, int]] = []
        for k in np.flatnonzero(high > low):
            p = int(in_doc[k])
            for t in in_item[low[k] : high[k]].tolist():
                if p and t and not free_doc[p - 1] and not free_item[t - 1] and doc[p - 1] == item[t - 1]:
                    continue  # the run before it is found too
                e = n
                while p + e < doc.size and t + e < item.size and not free_doc[p + e] and not free_item[t + e] and doc[p + e] == item[t + e]:
                    e += 1
                queue.append((-e, p, t))
        heapify(queue)
        while queue:
            e, p, t = heappop(queue)
            marked = free_doc[p : p - e] | free_item[t : t - e]
            if not marked.any():
                free_doc[p : p - e] = True
                free_item[t : t - e] = True
                out.append((p, t, -e))
                continue
            # what is left of it on both sides of marked words waits for its turn
            edges = np.flatnonzero(np.diff(np.concatenate(([1], marked, [1]))))
            for s, end in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
                if end - s >= n:
                    heappush(queue, (s - end, p + s, t + s))
    return sorted(out)


class Seeds:
    """Hashes of MIN_MATCH words of some benchmark items, sorted, with the items that hold them."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        grams = [np.unique(rolling(x, MIN_MATCH)) for _, x in items]
        owner = np.repeat(np.arange(len(items)), [g.size for g in grams])
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, self.owner = every[order], owner[order]
        # a shared seed covers MIN_MATCH words at most; an item can repeat a seed
        self.sizes = np.array([x.size for _, x in items])
        self.repeats = self.sizes - MIN_MATCH + 1 - np.array([g.size for g in grams])

    def leaks(self, doc: np.ndarray, threshold: float) -> Iterator[tuple[int | None, float, list]]:
        own = np.unique(rolling(doc, MIN_MATCH))
        low, high = np.searchsorted(self.grams, own), np.searchsorted(self.grams, own, "right")
        hit = high > low
        if not hit.any():
            return
        # the items of all hits at once: a passage of every item costs one count for each, not a step
        n = high[hit] - low[hit]
        places = np.repeat(low[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        counts = np.bincount(self.owner[places], minlength=len(self.items))
        for k in np.flatnonzero((counts + self.repeats) * MIN_MATCH >= threshold * self.sizes).tolist():
            if not counts[k]:
                continue
            name, item = self.items[k]
            laid = tiles(doc, item)
            coverage = sum(x[2] for x in laid) / item.size
            if coverage >= threshold:
                yield name, coverage, laid


SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, tiles array<struct<at:long,item_at:long,words:long>>"


def _blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    held, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = tokens(text)
        if words.size < MIN_MATCH:
            continue
        held.append((item_id, words))
        size += words.size
        if size >= BLOCK_SEEDS:
            yield Seeds(held)
            held, size = [], 0
    if held:
        yield Seeds(held)


def unsearched(benchmark: DataFrame) -> DataFrame:
    """item_id and n_words of the items that are too short to be searched."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([tokens(x).size for x in b.column("text").to_pylist()], pa.int64())], ["item_id", "n_words"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(task, "item_id long, n_words long").where(F.col("n_words") < MIN_MATCH)


def report(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The leaks: doc_id, item_id, coverage and tiles (places and lengths in words)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def against(seeds: Seeds) -> DataFrame:
        shared = spark.sparkContext.broadcast(seeds)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(d, i, c, x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t for i, c, x in shared.value.leaks(tokens(t), threshold)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.float64()),
                        pa.array([len(x[3]) for x in out], pa.int32()),
                        pa.array([[{"at": p, "item_at": t, "words": e} for p, t, e in x[3]] for x in out], pa.list_(pa.struct([("at", pa.int64()), ("item_at", pa.int64()), ("words", pa.int64())]))),
                    ],
                    ["doc_id", "item_id", "coverage", "n_tiles", "tiles"],
                )

        return rows.mapInArrow(task, SCHEMA)

    found = [against(x) for x in _blocks(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], SCHEMA)


def drop(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that leak no item, with all their columns; judged in place, so even rows without doc_id are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for seeds in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(seeds)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([next(shared.value.leaks(tokens(t), threshold), None) is None for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
