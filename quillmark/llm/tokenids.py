"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds documents in ascending order of doc_id. Its ids stand one after
the other in 16 bits (32 where an id needs it). Boundaries, the number of ids up
to the end of each document, are a non-decreasing sequence in Elias-Fano form:
low bits packed, high bits in unary in a bit vector, at most 2 + log2(u / n)
bits a document. select(i) finds the i-th one bit by a sampled directory of
bytes, stored in the file as 32-bit numbers, so offsets come back without a table of 64-bit
numbers and without reading the other boundaries. Files are read through it: a task takes the
ends of the documents it wants, all of them or a few (`fetch`).

Files are the binary rows of a Parquet table, one row a file, which Spark's
committer writes to any file system and finishes once if an executor is lost.
Files are cut at FILE_IDS ids (a longer document has a file of its own), and their
order is (part, file), parts being ranges of doc_id.

Nulls and odd input: a null text is empty and yields the end id alone. Null
doc_ids come first. Rows of equal doc_id (or of none) are ordered by a hash of the text, then by text, so that
they can fill several parts, and get entries of their own. Extra columns are not looked at. An
empty table gives no file. A document is a cell of its file, so its ids are bounded by the 2 GB of a cell. Texts of any length are encoded piece by piece, cut
where the tokenizer itself always cuts: between a visible character and a space.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import bounded_batches, written

END_ID = 0
FILE_IDS = 1 << 20
#: Words whose ids a worker remembers at most.
REMEMBERED = 1_200_000
#: Characters of text that are coded at a time, about.
SLICE = 1 << 23
MAGIC = b"QEF2"
#: New words that the tokenizer gets as one text, and texts that it gets at a time.
CHAIN, CHAINS = 256, 64
SAMPLE = 64
#: A space where `pieces` does not cut: at the beginning, or after what is no visible ASCII character, letter or digit.
UNEVEN = r"^ |[^!-~\pL\pN] "
#: A piece that can be encoded in a chain.
FIT = r"(?s)^ .*[!-~\pL\pN]$"
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of n numbers up to u."""

    def __init__(self, n: int, u: int, low: bytes, high: bytes, directory: np.ndarray):
        self.n, self.u, self.low, self.high, self.directory = n, u, low, high, directory
        self.width = self.bits(n, u)

    @staticmethod
    def bits(n: int, u: int) -> int:
        return max(0, (u // n).bit_length() - 1) if n else 0

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = values.size
        u = int(values[-1]) if n else 0
        width = cls.bits(n, u)
        low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
        places = (values >> width) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        bits = np.packbits(high, bitorder="little")
        # ones before every SAMPLE-th byte
        directory = np.cumsum(np.concatenate(([0], np.add.reduceat(ONES[bits], np.arange(0, bits.size, SAMPLE), dtype=np.int64)[:-1]))) if n else np.empty(0)
        return cls(n, u, np.packbits(low, bitorder="little").tobytes(), bits.tobytes(), directory.astype("<u4"))

    def select(self, wanted: np.ndarray) -> np.ndarray:
        """The numbers at the wanted places (from 0, ascending); only the parts of the bit vector that hold them are looked at."""
        if not wanted.size:
            return np.empty(0, np.int64)
        block = np.searchsorted(self.directory, wanted, "right") - 1
        blocks, at = np.unique(block, return_inverse=True)
        high = np.frombuffer(self.high, np.uint8)
        own = np.zeros((blocks.size, SAMPLE), np.uint8)
        for row, k in zip(own, blocks.tolist(), strict=True):
            part = high[k * SAMPLE : (k + 1) * SAMPLE]
            row[: part.size] = part
        row, bit = np.nonzero(np.unpackbits(own, axis=1, bitorder="little"))
        first = np.searchsorted(row, np.arange(blocks.size))
        places = bit[first[at] + wanted - self.directory[block]] + 8 * SAMPLE * block
        bits = wanted[:, None] * self.width + np.arange(self.width)
        low = (np.frombuffer(self.low, np.uint8)[bits >> 3] >> (bits & 7) & 1).astype(np.int64) << np.arange(self.width)
        return ((places - wanted) << self.width) | low.sum(axis=1)


HEAD = "<4sBQQQQQ"


def pack(flat: np.ndarray, ends: np.ndarray) -> bytes:
    """A file from the ids of all its documents and the number of ids up to the end of each."""
    ef = EliasFano.encode(ends)
    narrow = not flat.size or int(flat.max()) < 1 << 16
    head = struct.pack(HEAD, MAGIC, 2 if narrow else 4, ef.n, ef.u, len(ef.low), len(ef.high), ef.directory.size)
    return head + ef.directory.tobytes() + ef.low + ef.high + flat.astype("<u2" if narrow else "<u4").tobytes()


def unpack(file: bytes) -> tuple[EliasFano, np.ndarray]:
    """Boundaries and ids of a file."""
    magic, width, n, u, low, high, blocks = struct.unpack_from(HEAD, file)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = struct.calcsize(HEAD)
    directory = np.frombuffer(file, "<u4", blocks, at)
    at += 4 * blocks
    ef = EliasFano(n, u, file[at : at + low], file[at + low : at + low + high], directory)
    return ef, np.frombuffer(file, f"<u{width}", offset=at + low + high)


def documents(file: bytes, wanted: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts and ids of the wanted documents of a file (places from 0, ascending), or of all."""
    ef, ids = unpack(file)
    wanted = np.arange(ef.n) if wanted is None else wanted
    ends = ef.select(wanted)
    begins = np.zeros(wanted.size, np.int64)
    begins[wanted > 0] = ef.select(wanted[wanted > 0] - 1)
    return begins, [ids[s:e] for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def _visible(c: str) -> bool:
    return c.isalnum() or "!" <= c <= "~"


def pieces(text: str) -> list[str]:
    """The text cut before spaces, but only after a visible ASCII character, letter or digit: no token crosses there."""
    parts = text.split(" ")
    if all(map(_visible, {x[-1:] for x in parts[:-1]})):
        return [parts[0], *[" " + x for x in parts[1:]]]
    out = [parts[0]]
    for before, x in zip(parts, parts[1:], strict=False):
        if _visible(before[-1:]):
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out


class Encoder:
    """Ids of texts as bytes; words seen before are remembered, others go to the tokenizer in batches.

    Texts that can be cut before every space are split and coded as columns, so that only
    distinct words are looked up one by one. A full memory forgets the later half: frequent words were met early.
    """

    held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for all tasks that a worker runs."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        # a byte-level token has a character for each byte
        names = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(names.values()) + 1, np.int64)
        self.sizes[list(names.values())] = [len(x) for x in names]

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces. Those that begin with a space and end in a visible character are
        encoded one after the other as texts of CHAIN pieces, as no token crosses from one to the next, and told
        apart by the bytes of their tokens; where these don't meet the pieces' ends, and for other pieces, each is a text.
        """
        column = pa.array(new, pa.large_string())
        fit = pc.match_substring_regex(column, FIT).to_numpy(zero_copy_only=False)
        chained, lone = column.filter(pa.array(fit)).to_pylist(), column.filter(pa.array(~fit)).to_pylist()
        sizes = pc.binary_length(column.filter(pa.array(fit))).to_numpy()
        for g in range(0, len(chained), CHAIN * CHAINS):  # encodings are large while they last
            part = chained[g : g + CHAIN * CHAINS]
            found = self.tokenizer.encode_batch_fast(["".join(part[i : i + CHAIN]) for i in range(0, len(part), CHAIN)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
            ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum(sizes[g : g + len(part)])
            stops = np.searchsorted(ends, wanted)
            raw, at = ids.tobytes(), np.concatenate(([0], 4 * (stops + 1)))
            self.known.update(zip(part, map(raw.__getitem__, map(slice, at[:-1].tolist(), at[1:].tolist())), strict=True))
            # a token that crosses a piece's end spoils that piece and the next
            odd = np.flatnonzero(ends[np.minimum(stops, ends.size - 1)] != wanted)
            lone += [part[i] for i in sorted({*odd.tolist(), *(odd + 1).tolist()}) if i < len(part)]
        for i in range(0, len(lone), 4096):
            part = lone[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, "<u4").tobytes()

    def _ids(self, distinct: list[str]) -> list[bytes]:
        """Ids of pieces."""
        known = self.known
        out = list(map(known.get, distinct))
        new = [p for p, x in zip(distinct, out, strict=True) if x is None]
        if new:
            if len(known) + len(new) > REMEMBERED:
                self.known = dict(islice(known.items(), REMEMBERED // 2))
            self._learn(new)
            out = [self.known[p] if x is None else x for p, x in zip(distinct, out, strict=True)]
        return out

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by end_id, and the number of ids up to the end of each text."""
        n = len(texts)
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        # an uneven text is one piece of its own kind, coded after the words
        parts = pc.split_pattern(pc.if_else(pa.array(uneven), "", texts), " ")
        coded, at = parts.values.dictionary_encode(), parts.offsets.to_numpy().astype(np.int64)
        words, codes = coded.dictionary, coded.indices.to_numpy()
        # the first word of a text has no space in front of it: these are coded after the others
        firsts, place = np.unique(codes[at[:-1]], return_inverse=True)
        table = self._ids(pc.binary_join_element_wise(pa.scalar(" ", words.type), words, pa.scalar("", words.type)).to_pylist())
        table += self._ids(words.take(pa.array(firsts)).to_pylist())
        place = place + len(words)
        for i in np.flatnonzero(uneven).tolist():
            cut = pieces(texts[i].as_py())
            distinct = list(dict.fromkeys(cut))
            of = dict(zip(distinct, self._ids(distinct), strict=True))
            place[i] = len(table)
            table.append(b"".join(map(of.__getitem__, cut)))
        # the end id is a word after the last of each text
        every = np.empty(codes.size + n, np.int32)
        ends = at[1:] + np.arange(n)
        inside = np.ones(every.size, bool)
        inside[ends] = False
        every[inside], every[ends] = codes, len(table)
        every[at[:-1] + np.arange(n)] = place
        taken = pa.array([*table, struct.pack("<I", end_id)], pa.large_binary()).take(pa.array(every))
        _, offsets, data = taken.buffers()
        stops = np.frombuffer(offsets, np.int64)[: every.size + 1][1:][ends] // 4
        return np.frombuffer(data, "<u4", int(stops[-1]) if n else 0), stops


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_ids and texts (null as empty) of about SLICE characters, across batches."""
    keys, texts, size = [], [], 0
    for b in batches:
        column = pc.fill_null(b.column("text").cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        at = 0
        while at < ends.size:
            done = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + SLICE - size, "right")))
            keys.append(b.column("doc_id").slice(at, upto - at))
            texts.append(column.slice(at, upto - at))
            size += int(ends[upto - 1]) - done
            at = upto
            if size >= SLICE or at < ends.size:
                yield pa.concat_arrays(keys), pa.concat_arrays(texts)
                keys, texts, size = [], [], 0
    if keys:
        yield pa.concat_arrays(keys), pa.concat_arrays(texts)


def write_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files; returns part, file, doc_ids, payload, n_ids as read from storage. Documents are shuffled once, by range of doc_id."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, file = Encoder.of(path), TaskContext.get().partitionId(), 0
        keys, held, sizes, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, sizes, total, file
            row = [part], [file], [pa.concat_arrays(keys)], [pack(np.concatenate(held), np.cumsum(np.concatenate(sizes)))], [total]
            kinds = pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64()
            keys, held, sizes, total, file = [], [], [], 0, file + 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "file", "doc_ids", "payload", "n_ids"])

        for doc_ids, texts in _slices(batches):
            flat, ends = encoder.encode(texts)
            at, base = 0, 0
            while at < ends.size:
                upto = int(np.searchsorted(ends, base + FILE_IDS - total, "right"))
                if upto <= at:
                    if total:
                        yield flush()
                        continue
                    upto = at + 1
                keys.append(doc_ids[at:upto])
                held.append(flat[base : ends[upto - 1]])
                sizes.append(np.diff(ends[at:upto], prepend=base))
                total += int(ends[upto - 1]) - base
                at, base = upto, int(ends[upto - 1])
        if total:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return written(ordered.select("doc_id", "text").mapInArrow(encode, "part int, file int, doc_ids array<long>, payload binary, n_ids long"), "tokens")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    meta = files.select("part", "file", "n_ids")
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = meta.select("part", "file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("file_start")).join(parts, "part")
    starts = starts.select("part", "file", (F.col("part_start") + F.col("file_start")).alias("at"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, keys, payload in zip(*(b.column(c) for c in ("part", "file", "doc_ids", "payload")), strict=True):
                begins, ids = documents(payload.as_py())
                n = begins.size
                sums = [zlib.crc32(x.astype("<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(part, n), pa.repeat(file, n), keys.values, pa.array(begins), pa.array([x.size for x in ids], pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "file", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "file", "doc_ids", "payload").mapInArrow(decode, "part int, file int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "file"]).select("doc_id", (F.col("at") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", "part", "file")


def fetch(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the documents of the given ids: of the files that hold any, only their boundaries are selected."""
    wanted = np.unique(np.array(doc_ids, np.int64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, payload in zip(b.column("doc_ids"), b.column("payload"), strict=True):
                own = keys.values.fill_null(-1).to_numpy()
                at = np.flatnonzero(np.isin(own, wanted) & keys.values.is_valid().to_numpy(zero_copy_only=False))
                ids = documents(payload.as_py(), at)[1]
                yield pa.RecordBatch.from_arrays([pa.array(own[at], pa.int64()), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    held = files.where(F.arrays_overlap("doc_ids", F.lit(wanted.tolist()).cast("array<long>"))) if wanted.size else files.limit(0)
    return held.select("doc_ids", "payload").mapInArrow(find, "doc_id long, ids array<long>")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_files(write_files(docs, path))
