import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import tokenids as t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 2), (1000, 3), (3000, 5000), (3000, 1)):
        v = np.cumsum(rng.integers(0, top, n))
        ef = t.EliasFano.encode(v)
        assert (ef.select(np.arange(n)) == v).all()
        some = np.unique(rng.integers(0, n, 40)) if n else np.empty(0, int)
        assert (ef.select(some) == v[some]).all() and all(ef.select(some[i : i + 1])[0] == v[some[i]] for i in range(some.size))
        if n > 100:
            assert 8 * (len(ef.low) + len(ef.high)) <= n * (3 + np.log2(max(2, ef.u / n)))


def test_pack_keeps_ids_of_both_widths():
    for big in (10, 70_000):
        file = t.pack(np.array([1, 2, big, 0], "<u4"), np.array([2, 2, 4]))
        assert [x.tolist() for x in t.documents(file)[1]] == [[1, 2], [], [big, 0]]
        begins, ids = t.documents(file, np.array([2]))
        assert begins.tolist() == [2] and ids[0].tolist() == [big, 0]


def test_pieces_encode_as_the_whole_text(monkeypatch):
    from tokenizers import Tokenizer

    path = t.tokenizer_path()
    whole, enc = Tokenizer.from_file(path), t.Encoder(path)
    rng = random.Random(3)
    alphabet = ["a", "bc", "É", "1", "23", " ", "  ", "\n", "\t", " ", "'s", "'", ".", ",", "!!", "日本", " ", "_", "\x1c", "́", "🙂", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice(alphabet[:5] + ["É", ".", "日本", "<|endoftext|>", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["", " ", "a ", " a", "a\n b", "word " * 5000]
    for remembered in (t.REMEMBERED, 100):  # a full memory forgets, and ids stay the same
        monkeypatch.setattr(t, "REMEMBERED", remembered)
        for k in range(0, len(texts), 700):
            part = texts[k : k + 700]
            flat, ends = enc.encode(pa.array(part, pa.large_string()))
            for x, s, e in zip(part, [0, *ends], ends, strict=False):
                assert flat[s:e].tolist() == ids_of(whole, x), repr(x)


def test_report_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(t.tokenizer_path())
    rng = random.Random(4)
    rows = [(3, "c d"), (1, None), (2, ""), (2, "b"), (None, "n"), (2, "b"), (9, "x " * 5000)]
    rows += [(i, " ".join(rng.choice(["über", "a", "Word", "\n", "12", "日本"]) for _ in range(rng.randrange(60)))) for i in range(20, 120)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, part string").repartition(3)
    files = t.write_files(df)
    assert files.count() > 20  # cut at FILE_IDS
    got = [tuple(r) for r in t.read_files(files).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert [x[0] for x in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [x[1] for x in got] == np.concatenate(([0], np.cumsum([x[2] for x in got])[:-1])).tolist()
    want = [(i, len(ids_of(whole, x)), zlib.crc32(np.array(ids_of(whole, x), "<u4").tobytes())) for i, x in rows]
    assert sorted((str(i), n, c) for i, _, n, c in got) == sorted((str(i), n, c) for i, n, c in want)
    fetched = {r.doc_id: r.ids for r in t.fetch(files, [1, 9, 50, 77_777]).collect()}
    assert fetched == {i: ids_of(whole, dict(rows)[i]) for i in (1, 9, 50)}
    assert t.fetch(files, []).count() == 0


def test_empty_table(spark):
    assert t.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(autouse=True)
def small_files(monkeypatch):
    monkeypatch.setattr(t, "FILE_IDS", 64)
    monkeypatch.setattr(t, "SLICE", 300)
