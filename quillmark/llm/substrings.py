"""Substring dedup by Rabin-Karp hashes of every window of fixed length.

The hash of every window of WINDOW words is computed by rolling. A repeated
window also repeats what is inside it, so before windows are counted, those
that cannot repeat are put aside: each window is known by the least hash of the
ANCHOR-word pieces inside it, and neighbours share that, so a document has one such
anchor for about thirteen windows. Only windows whose anchor occurs in two
documents are counted, by 96 bits of two hash families, and get the least doc_id in which they start. A window that
starts in a smaller document is removed; such windows merge into maximal
intervals. Exact copies are found first by digest: a copy of a smaller document
that has a window at all is removed whole, and only the first of each text is searched.

Counts and minima are combined before each shuffle, and joins on hashes are plain
equi-joins whose hot keys are split, so a passage in every document lands in no single task.

Nulls and odd input: a null text has no words. A row without doc_id is neither smaller
nor greater than any: it keeps all words and takes none. Rows that repeat a
doc_id do not remove each other's words. Texts under WINDOW words stay whole. Extra columns are not looked at, and an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.textkit import BASES, hash_words, rolling, sliding_min, spans
from quillmark.session import bounded_batches, written

WINDOW, ANCHOR = 50, 25
PER_BATCH = 200_000


def kept_digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> str:
    """SHA-256 of the kept words joined by one space."""
    raw = data.tobytes()
    words = range(starts.size) if keep is None else np.flatnonzero(keep)
    return hashlib.sha256(b" ".join([raw[starts[i] : ends[i]] for i in words])).hexdigest()


def anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of each window, in order of the windows' starts."""
    pieces = rolling(words, ANCHOR)
    return sliding_min(pieces, WINDOW - ANCHOR + 1) if words.size >= WINDOW else pieces[:0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, sums, own = [], [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            data, starts, ends = spans(text)
            n.append(starts.size)
            sums.append(kept_digest(data, starts, ends))
            own.append(np.unique(anchors(hash_words(text)[0])).view(np.int64))
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([x.size for x in own]))).astype(np.int32), np.concatenate(own) if own else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("v"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), lists], ["doc_id", "v", "n_words", "whole_sha256", "anchors"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, g (96 bits of hash), doc_id, at of each window whose anchor is shared; at is its place, and above 32 bits the number of the text among those of its doc_id."""
    for b in batches:
        held, size = [], 0
        for doc_id, text, shared, nth in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "shared", "nth")), strict=True):
            one, two = hash_words(text, 2)
            at = np.flatnonzero(np.isin(anchors(one), np.array(shared, np.int64).view(np.uint64)))
            h, g = rolling(one, WINDOW, BASES[1])[at], rolling(two, WINDOW)[at]
            at = at + (nth << 32)
            for k in range(0, at.size, PER_BATCH):
                held.append((h[k : k + PER_BATCH], g[k : k + PER_BATCH], at[k : k + PER_BATCH], doc_id))
                size += held[-1][0].size
                if size >= PER_BATCH:
                    yield _window_rows(held)
                    held, size = [], 0
        if held:
            yield _window_rows(held)


def _window_rows(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([x[0] for x in held]).view(np.int64)),
            pa.array((np.concatenate([x[1] for x in held]) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
            pa.array(np.repeat(np.array([x[3] for x in held], np.int64), [x[0].size for x in held])),
            pa.array(np.concatenate([x[2] for x in held]).astype(np.int64)),
        ],
        ["h", "g", "doc_id", "at"],
    )


_WINDOW_SCHEMA = "h long, g int, doc_id long, at long"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, sums = [], []
        for text, first, last in zip(*(b.column(c).to_pylist() for c in ("text", "first", "last")), strict=True):
            data, starts, ends = spans(text)
            step = np.zeros(starts.size + 1, np.int64)
            np.add.at(step, np.array(first, np.int64), 1)
            np.add.at(step, np.array(last, np.int64), -1)
            keep = np.cumsum(step)[:-1] == 0
            removed.append(int((~keep).sum()))
            sums.append(kept_digest(data, starts, ends, keep))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("v"), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "v", "n_removed", "kept_sha256"])


def intervals(hits: DataFrame) -> DataFrame:
    """doc_id, nth, first, last (word intervals, end exclusive, maximal and in order) from doc_id, at of removed windows."""
    hits = hits.select("doc_id", F.shiftright("at", 32).cast("int").alias("nth"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))
    runs = hits.groupBy("doc_id", "nth").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    starts = F.expr(f"filter(ats, (x, i) -> i = 0 OR x - ats[greatest(i - 1, 0)] > {WINDOW})")
    ends = F.expr(f"transform(filter(ats, (x, i) -> i = size(ats) - 1 OR ats[least(i + 1, size(ats) - 1)] - x > {WINDOW}), x -> x + {WINDOW})")
    return runs.select("doc_id", "nth", starts.alias("first"), ends.alias("last"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("v"))
    scanned = written(docs.mapInArrow(_scan, "doc_id long, v binary, n_words long, whole_sha256 string, anchors array<long>"), "scanned")
    # aggregates are written before they are joined, so that a join shuffles both its sides anew and adaptive execution can
    # split hot keys; an aggregate right below a join forbids that
    first = written(scanned.groupBy("v").agg(F.min("doc_id").alias("first")), "first")
    narrow = scanned.select("doc_id", "v", "n_words", "whole_sha256").join(first, "v")
    narrow = narrow.withColumn("copy", (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW))
    # the first document of each text, with its anchors
    own = scanned.where(F.size("anchors") > 0).join(first, "v").where("doc_id = first").select("doc_id", "v", "anchors").dropDuplicates(["doc_id", "v"])
    pieces = written(own.select("doc_id", "v", F.explode("anchors").alias("anchor")), "anchors")
    shared = written(pieces.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "shared")
    wanted = pieces.join(shared, "anchor").groupBy("doc_id", "v").agg(F.collect_list("anchor").alias("shared"))
    wanted = wanted.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("v")) - 1)
    searched = written(docs.join(wanted, ["doc_id", "v"]), "searched")
    windows = written(searched.select("doc_id", "text", "shared", "nth").mapInArrow(_windows, _WINDOW_SCHEMA), "windows")
    least = written(windows.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "g", "low"), "least")
    hits = windows.join(least, ["h", "g"]).where("doc_id > low").select("doc_id", "at")
    cut = searched.select("doc_id", "nth", "v", "text").join(intervals(hits), ["doc_id", "nth"]).mapInArrow(_remove, "doc_id long, v binary, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "v"])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return narrow.join(cut, ["doc_id", "v"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
