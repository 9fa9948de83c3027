"""Readers and sinks: files written, then read back with exact rows."""

import bz2
import gzip
import io
import tarfile
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark.operators import documents, textmining
from quillmark.sources import files, logs, sinks


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return path


def test_whole_files_and_globs(spark, tmp_path):
    for name, data in (("a/x.txt", b"one"), ("a/b/y.bin", b"\x00\xff"), ("a/.hidden", b"no"), ("c/z.txt", b"z")):
        put(tmp_path / name, data)
    got = {r.id.rsplit("/", 1)[1]: (bytes(r.content), r.length) for r in files.read_files(spark, str(tmp_path / "a")).collect()}
    assert got == {"x.txt": (b"one", 3), "y.bin": (b"\x00\xff", 2)}
    assert {r.id[-5:] for r in files.read_files(spark, str(tmp_path / "*" / "*.txt")).collect()} == {"x.txt", "z.txt"}


def test_crawl_limits(spark, tmp_path):
    for name, data in (("r/1.txt", b"1"), ("r/d/2.txt", b"22"), ("r/d/e/3.txt", b"333"), ("r/d/big.log", b"x" * 100)):
        put(tmp_path / name, data)
    root = str(tmp_path / "r")
    names = lambda **o: sorted(r.id.rsplit("/", 1)[1] for r in files.crawl(spark, root, **o).collect())
    assert names() == ["1.txt", "2.txt", "3.txt", "big.log"]
    assert names(depth=0) == ["1.txt"] and names(depth=1) == ["1.txt", "2.txt", "big.log"]
    assert names(max_bytes=2) == ["1.txt", "2.txt"] and names(include=[r"\.txt$"], exclude=["/e/"]) == ["1.txt", "2.txt"]


def test_archives_are_unpacked(spark, tmp_path):
    zipped, tarred = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("in/a.txt", "A")
    with tarfile.open(fileobj=tarred, mode="w:gz") as t:
        info = tarfile.TarInfo("b.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"BB"))
    put(tmp_path / "one.zip", zipped.getvalue())
    put(tmp_path / "two.tar.gz", tarred.getvalue())
    put(tmp_path / "three.tar.bz2", bz2.compress(gzip.decompress(tarred.getvalue())))
    put(tmp_path / "four.ar", b"!<arch>\n" + b"c.txt/".ljust(16) + b"0".ljust(12) + b"0".ljust(6) + b"0".ljust(6) + b"644".ljust(8) + b"3".ljust(10) + b"`\n" + b"CCC\n")
    entry = b"070701" + b"".join(b"%08x" % x for x in (1, 0o100644, 0, 0, 1, 0, 4, 0, 0, 0, 0, 6, 0)) + b"d.txt\x00" + b"DDDD"
    last = b"070701" + b"".join(b"%08x" % x for x in (0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 11, 0)) + b"TRAILER!!!\x00"
    put(tmp_path / "five.cpio", entry + last)
    put(tmp_path / "plain.txt", b"P")
    got = {r.url.rsplit("/", 1)[1] if "!in" not in r.url else "one.zip!in/a.txt": bytes(r.content) for r in files.corpus(spark, str(tmp_path), "lang=en;x=y").collect()}
    assert got == {"one.zip!in/a.txt": b"A", "two.tar.gz!b.txt": b"BB", "three.tar.bz2!b.txt": b"BB", "four.ar!c.txt": b"CCC", "five.cpio!d.txt": b"DDDD", "plain.txt": b"P"}
    assert files.corpus(spark, str(tmp_path), "lang=en;x=y").first().metadata == {"lang": "en", "x": "y"}


def test_sequence_files(spark, tmp_path):
    sc = spark.sparkContext
    sc.parallelize([("k1", "text one"), ("k2", "two")]).saveAsSequenceFile(str(tmp_path / "t"))
    sc.parallelize([("k3", bytearray(b"\x01\x02"))]).saveAsSequenceFile(str(tmp_path / "b"))
    assert {(r.id, r.text, r.content) for r in files.read_sequence_files(spark, str(tmp_path / "t")).collect()} == {("k1", "text one", None), ("k2", "two", None)}
    assert [(r.id, r.text, bytes(r.content)) for r in files.read_sequence_files(spark, str(tmp_path / "b")).collect()] == [("k3", None, b"\x01\x02")]


def warc(kind, uid, url, body, size=None):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uid}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_warc_and_arc(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>caf\xc3\xa9</p>"
    data = warc("warcinfo", "0", "", b"software: x") + warc("response", "id-1", "http://a/", page) + warc("response", "bad", "http://bad/", b"", "many") + warc("resource", "id-2", "http://b/", b"raw\r\n\r\nWARC")
    put(tmp_path / "w" / "one.warc", data)
    put(tmp_path / "w" / "two.warc.gz", gzip.compress(warc("response", "id-3", "http://c/", page)) + gzip.compress(warc("request", "id-4", "http://d/", b"GET")))
    got = {r.id: (r.url, bytes(r.content), r.fields["warc.warc-type"]) for r in files.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {"id-1": ("http://a/", b"<p>caf\xc3\xa9</p>", "response"), "id-2": ("http://b/", b"raw\r\n\r\nWARC", "resource"), "id-3": ("http://c/", b"<p>caf\xc3\xa9</p>", "response")}
    rows = files.as_corpus(files.read_warc(spark, str(tmp_path / "w")))
    assert rows.columns == ["url", "contentType", "content", "metadata"] and {r.contentType for r in rows.collect()} == {"text/html"}
    arc = b"filedesc://x 0.0.0.0 20260101 text/plain 5\nabcde\n" + b"http://e/ 1.2.3.4 20260101000000 text/html %d\n" % len(page) + page + b"\nhttp://f/ 1.2.3.4 20260101000000 text/plain 3\nend\n"
    put(tmp_path / "a" / "x.arc.gz", gzip.compress(arc))
    got = {r.id: (r.contentType, bytes(r.content), r.fields["ip"]) for r in files.read_arc(spark, str(tmp_path / "a")).collect()}
    assert got == {"http://e/": ("text/html", b"<p>caf\xc3\xa9</p>", "1.2.3.4"), "http://f/": ("text/plain", b"end", "1.2.3.4")}


def test_jdbc_full_and_delta(spark, tmp_path):
    url = f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true"
    rows = spark.createDataFrame([(i, f"n{i}", f"2026-01-{i:02d}") for i in range(1, 10)], "ID int, NAME string, DAY string")
    rows.write.format("jdbc").options(url=url, dbtable="docs", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="NAME varchar(20), DAY varchar(20)").save()
    read = lambda **o: files.read_jdbc(spark, url, "SELECT id, name, day FROM docs", driver="org.apache.derby.jdbc.EmbeddedDriver", **o)
    assert read(column="ID", bounds=(1, 10), partitions=3).count() == 9 and read(column="ID", bounds=(1, 10), partitions=3).rdd.getNumPartitions() == 3
    assert sorted(r[0] for r in read(since=("day", "2026-01-06")).collect()) == [7, 8, 9]
    assert read(since=("day", "3' OR '1'='1")).count() == 0  # a value, never SQL
    with pytest.raises(ValueError):
        read(since=("day; DROP TABLE docs", "x"))


def test_uncleaned_logs_keep_gaps(spark, tmp_path):
    lines = ["Q", "c", "1000", "words, \"x\"", "id1", "3"], ["Q", "c", "", "gap", "id2", "1"], ["Q", "c", "2000", "none", "", "0"]
    put(tmp_path / "q.log", "\n".join("\x1f".join(x) for x in lines).encode())
    assert [(r.id, r.query, r.hits) for r in logs.read_query_logs(spark, str(tmp_path)).collect()] == [("id1", 'words, "x"', 3)]
    assert logs.read_query_logs(spark, str(tmp_path), cleaned=False).count() == 3


def test_suffix_types():
    assert files.suffix_type("n_i") == ("n", "int") and files.suffix_type("plain") == ("plain", "string") and files.suffix_type("a_d")[1] == "double"


def test_content_archives(spark):
    df = spark.createDataFrame([(f"http://h/{i}", f"text {i}") for i in range(25)], "url string, text string").coalesce(1)
    rows = sinks.archives(df, per_archive=10).collect()
    assert [len(r.entries) for r in rows] == [10, 10, 5]
    got = {}
    for r in rows:
        with zipfile.ZipFile(io.BytesIO(bytes(r.payload))) as z:
            got |= {e.key: z.read(e.name).decode() for e in r.entries}
    assert got == {f"http://h/{i}": f"text {i}" for i in range(25)}
    assert [e.name for e in sinks.archives(df, per_archive=2, names="NUM").first().entries] == ["000000", "000001"]


def test_index_rows_and_tee(spark, tmp_path):
    note = "array<struct<type:string,start:bigint,end:bigint,features:map<string,string>>>"
    docs = spark.createDataFrame([("a", "Ann met Bob", {"lang": "en"}, [("Person", 0, 3, {"string": "ann"}), ("Person", 8, 11, {}), ("Place", 0, 3, {})], bytearray(b"raw"))], f"id string, text string, metadata map<string,string>, annotations {note}, content binary")
    r = sinks.index_rows(docs, {"who": "Person", "name": "Person.string"}).first()
    assert (r.id, r.who, r.name, r.meta) == ("a", ["Ann", "Bob"], ["ann"], {"meta_lang": "en"})
    sinks.write_index(docs, str(tmp_path / "i"), {"who": "Person"})
    assert spark.read.parquet(str(tmp_path / "i")).count() == 1
    for _ in range(2):  # a repeated batch overwrites itself
        sinks.tee(docs, str(tmp_path / "t"), 7)
    assert spark.read.parquet(str(tmp_path / "t/content")).select("id", "content").collect()[0].content == bytearray(b"raw")
    assert "content" not in spark.read.parquet(str(tmp_path / "t/documents")).columns and spark.read.parquet(str(tmp_path / "t/documents")).count() == 1
    inside = docs.select(documents.annotations("Person", "str.*", "an+").alias("a"), documents.annotations(within=(8, 20)).alias("b")).first()
    assert len(inside.a) == 1 and len(inside.b) == 1


def test_libsvm_file_and_similar_documents(spark, tmp_path):
    w = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "c", 0.5), (3, "a", 1.0)], "doc_id long, term string, weight double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    lines = textmining.libsvm_rows(w, labels)
    sinks.write_libsvm(lines, str(tmp_path / "svm"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "svm")).collect()) == ["0 3:0.5", "1 1:1.0 2:2.0"]
    assert spark.read.format("libsvm").option("numFeatures", 3).load(str(tmp_path / "svm")).count() == 2
    found = textmining.row_similarity(w)
    assert [(r.a, r.b, round(r.score, 6)) for r in found.collect()] == [(1, 3, round(1 / 5**0.5, 6))]
    names = spark.createDataFrame([(1, "one"), (3, "three")], "row long, id string")
    listed = {r.doc: [(x.id, round(x.score, 4)) for x in r.similar] for r in textmining.similar_documents(found, names).collect()}
    assert listed == {"one": [("three", 0.4472)], "three": [("one", 0.4472)]}
    assert textmining.simdoc_map(textmining.similar_documents(found)).where("doc = 1").first().simdoc.keys() == {"3"}
    tied = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.9)], "a long, b long, score double")
    assert [x.id for x in textmining.similar_documents(tied).where("doc = 1").first().similar] == [4, 2, 3]
    sip = textmining.sips(spark.createDataFrame([("a b", 3, 1.5)], "phrase string, n long, llr double")).first()
    assert (sip.id, sip.sip_score) == ("a b", 1.5)


def test_router_uses_the_string_hash(spark):
    ids = ["", "a", "hello", "http://example.org/a?b=c", "é日本", "🙂x", "polygenelubricants", "x" * 500]
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    want = {x: spark._jvm.java.util.Objects.hashCode(x) & 0xFFFFFFFF for x in ids}
    assert {r.id: r.h for r in df.select("id", documents.string_hash(F.col("id")).alias("h")).collect()} == want
    assert {r.id: r.s for r in df.select("id", documents.shard(F.col("id"), 7).alias("s")).collect()} == {x: (h >> 1) % 7 for x, h in want.items()}
