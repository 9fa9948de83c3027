"""Readers that turn files into document rows: CSV, directories, archives, SolrXML, WARC and ARC, JDBC.

Files are read by Spark's own sources, whatever the file system; only splitting a container
into records runs in Python, batch by batch, on the executors.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.documents import ANNOTATION

#: CSV strategies: delimiter and quote.
CSV = {"default": {"sep": ",", "quote": '"'}, "excel": {"sep": ",", "quote": '"', "escape": '"'}, "tdf": {"sep": "\t", "quote": '"'}}


def read_csv(spark: SparkSession, path, mapping: str = "", id_field: str = "id", strategy: str = "default", header: bool = True) -> DataFrame:
    """Documents from CSV: mapping '0=id,1=title', other columns field_<i>; the first line of each file is a header."""
    raw = spark.read.options(**CSV[strategy], header=str(header).lower(), enforceSchema="true").csv(path)
    names = {int(k): v for k, _, v in (x.partition("=") for x in mapping.split(",") if x)}
    renamed = raw.toDF(*[names.get(i, f"field_{i}") for i in range(len(raw.columns))])
    rest = [c for c in renamed.columns if c != id_field]
    fields = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c) for c in rest])), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    key = F.col(id_field) if id_field in renamed.columns else F.uuid()
    return renamed.select(key.alias("id"), fields.alias("fields"))


def read_files(spark: SparkSession, path, recursive: bool = True) -> DataFrame:
    """Whole files: id (path), content, length, modified; hidden files are left out, as are files of no bytes, which Spark does not list. Globs are expanded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.substring_index("path", "/", -1)
    return raw.where(~F.startswith(name, F.lit(".")) & ~F.startswith(name, F.lit("_"))).select(F.col("path").alias("id"), "content", "length", F.col("modificationTime").alias("modified"))


def crawl(spark: SparkSession, root: str, depth: int = -1, max_bytes: int = -1, include: list[str] | None = None, exclude: list[str] | None = None, modified_after: str | None = None) -> DataFrame:
    """Files under a root: at most depth folders down and max_bytes long, matching an include pattern (none: all) and no exclude pattern."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.load(root).select(F.col("path").alias("id"), "content", "length", F.col("modificationTime").alias("modified"))
    base = re.sub(r"^[a-z0-9]+:/*", "", root).strip("/")
    inside = F.regexp_replace("id", r"^[a-z0-9]+:/*", "")
    ok: Column = F.startswith(inside, F.lit(base))
    if depth >= 0:
        ok = ok & (F.size(F.split(F.ltrim(F.substring("id", F.instr("id", base) + len(base), F.lit(1 << 30)), F.lit("/")), "/")) - 1 <= depth)
    if max_bytes >= 0:
        ok = ok & (F.col("length") <= max_bytes)
    if include:
        ok = ok & F.col("id").rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        ok = ok & ~F.col("id").rlike("|".join(f"(?:{p})" for p in exclude))
    return files.where(ok)


def _members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    low = name.lower()
    if low.endswith((".zip", ".jar")):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for x in z.infolist():
                if not x.is_dir():
                    yield f"{name}!{x.filename}", z.read(x)
    elif low.endswith((".tar", ".tgz", ".tar.gz", ".tbz", ".tbz2", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for x in t:
                if x.isfile():
                    yield f"{name}!{x.name}", t.extractfile(x).read()
    elif low.endswith((".a", ".ar")):
        at = 8
        while at + 60 <= len(data):
            head = data[at : at + 60]
            size = int(head[48:58])
            yield f"{name}!{head[:16].decode('ascii', 'replace').strip().rstrip('/')}", data[at + 60 : at + 60 + size]
            at += 60 + size + size % 2
    elif low.endswith(".cpio"):
        at = 0
        while data[at : at + 6] in (b"070701", b"070702"):
            size, name_size = int(data[at + 54 : at + 62], 16), int(data[at + 94 : at + 102], 16)
            entry = data[at + 110 : at + 110 + name_size - 1].decode("utf-8", "replace")
            start = at + (110 + name_size + 3) // 4 * 4
            if entry == "TRAILER!!!":
                return
            if size:
                yield f"{name}!{entry}", data[start : start + size]
            at = start + (size + 3) // 4 * 4
    else:
        yield name, data


def corpus(spark: SparkSession, path, metadata: str = "", unpack: bool = True) -> DataFrame:
    """Documents of a folder, archives unpacked to path!entry, with constant metadata 'k=v;k=v'."""
    files = read_files(spark, path)
    constant = {k: v for k, _, v in (x.partition("=") for x in metadata.split(";") if x)}

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["id"], pdf["content"], strict=True):
                rows = list(_members(name, bytes(data)))
                yield pd.DataFrame({"url": [x[0] for x in rows], "content": [x[1] for x in rows]})

    rows = files.select("id", "content").mapInPandas(task, "url string, content binary") if unpack else files.select(F.col("id").alias("url"), "content")
    pairs = [F.lit(x) for kv in constant.items() for x in kv]
    return rows.withColumn("metadata", (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>"))


def read_corpus(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Documents from corpus rows (url, contentType, text, content, metadata, annotations): metadata becomes fields, annotations are kept."""
    rows = spark.read.parquet(path)

    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)

    fields = F.coalesce(column("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select(
        F.col("url").alias("id"), F.lit(collection).alias("collection"), column("contentType", "string"), column("text", "string"), column("content", "binary"),
        fields.alias("fields"), F.coalesce(column("annotations", f"array<{ANNOTATION}>"), F.array().cast(f"array<{ANNOTATION}>")).alias("annotations"),
    )


def read_sequence_files(spark: SparkSession, path: str) -> DataFrame:
    """id, text (of text values), content (of byte values) from Hadoop sequence files."""
    def row(kv):
        k, v = kv
        return (str(k), v if isinstance(v, str) else None, bytes(v) if isinstance(v, (bytes, bytearray)) else None if isinstance(v, str) else str(v).encode())

    return spark.createDataFrame(spark.sparkContext.sequenceFile(path).map(row), "id string, text string, content binary")


def _fields(field: Column) -> tuple[Column, Column]:
    """(fields, boosts): a repeated plain field is overwritten, fields marked update are joined into lists."""
    usable = F.filter(field, lambda f: ~F.coalesce(f["_null"], F.lit(False)))
    names = F.array_distinct(F.transform(usable, lambda f: f["_name"]))

    def values(n: Column) -> Column:
        own = F.filter(usable, lambda f: f["_name"] == n)
        updates = F.filter(own, lambda f: f["_update"].isNotNull())
        plain = F.filter(own, lambda f: f["_update"].isNull())
        return F.when(F.size(updates) > 0, F.array_join(F.transform(updates, lambda f: f["_VALUE"]), ",")).otherwise(F.element_at(plain, -1)["_VALUE"])

    def boost(n: Column) -> Column:
        return F.aggregate(F.filter(usable, lambda f: f["_name"] == n), F.lit(1.0), lambda a, f: a * F.coalesce(f["_boost"], F.lit(1.0)))

    return F.map_from_arrays(names, F.transform(names, values)), F.map_filter(F.map_from_arrays(names, F.transform(names, boost)), lambda _, b: b != 1.0)


def read_solr_xml(spark: SparkSession, path, prefix: str = "doc_") -> DataFrame:
    """Documents of <add><doc boost><field name boost update null>: id, fields, boosts (document boost times field boost), boost."""
    schema = "_boost double, field array<struct<_VALUE:string,_name:string,_boost:double,_update:string,_null:boolean>>"
    raw = spark.read.format("xml").schema(schema).option("rowTag", "doc").load(path)
    fields, boosts = _fields(F.coalesce("field", F.array().cast("array<struct<_VALUE:string,_name:string,_boost:double,_update:string,_null:boolean>>")))
    doc_boost = F.coalesce("_boost", F.lit(1.0))
    rows = raw.select(fields.alias("fields"), boosts.alias("b"), doc_boost.alias("boost"))
    key = F.coalesce(F.try_element_at("fields", F.lit("id")), F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string")))
    return rows.select(key.alias("id"), F.map_filter("fields", lambda k, _: k != "id").alias("fields"), F.transform_values("b", lambda _, b: b * F.col("boost")).alias("boosts"), "boost")


def _warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        head = {}
        for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        size = head.get("content-length") or "0"
        if not size.isdigit():  # a bad record ends where the next one begins
            at = end + 4
            continue
        yield head, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)


def _arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").split(" ") if end >= 0 else []
        if len(parts) < 5 or not parts[-1].strip().isdigit():
            if end < 0:
                return
            at = end + 1
            continue
        size = int(parts[-1])
        yield {"url": parts[0], "ip": parts[1], "date": parts[2], "content-type": parts[3]}, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def _containers(files: DataFrame, records) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["id"], pdf["content"], strict=True):
                rows = [(name, i, h, b) for i, (h, b) in enumerate(records(bytes(data)))]
                yield pd.DataFrame(rows, columns=["file", "n", "headers", "content"])

    return files.select("id", "content").mapInPandas(task, "file string, n int, headers map<string,string>, content binary")


def read_warc(spark: SparkSession, path) -> DataFrame:
    """id (record id without its urn), url, content, fields with warc. in front; response and resource records."""
    rows = _containers(read_files(spark, path), _warc_records)
    h = lambda k: F.try_element_at("headers", F.lit(k))
    fields = F.transform_keys("headers", lambda k, _: F.concat(F.lit("warc."), k))
    return rows.where(h("warc-type").isin("response", "resource", "conversion")).select(F.regexp_extract(h("warc-record-id"), r"(?:urn:uuid:)?([^<>:]+)>?$", 1).alias("id"), h("warc-target-uri").alias("url"), http_body(F.col("content")).alias("content"), fields.alias("fields"))


def http_body(content: Column) -> Column:
    """A recorded response without its HTTP head."""
    text = F.decode(content, "ISO-8859-1")
    at = F.instr(text, "\r\n\r\n")
    return F.when(F.startswith(text, F.lit("HTTP/")) & (at > 0), F.encode(F.substring(text, at + 4, F.lit(1 << 30)), "ISO-8859-1")).otherwise(content)


def read_arc(spark: SparkSession, path) -> DataFrame:
    rows = _containers(read_files(spark, path), _arc_records)
    h = lambda k: F.try_element_at("headers", F.lit(k))
    return rows.where(~F.startswith(h("url"), F.lit("filedesc:"))).select(h("url").alias("id"), h("content-type").alias("contentType"), http_body(F.col("content")).alias("content"), F.col("headers").alias("fields"))


def as_corpus(records: DataFrame) -> DataFrame:
    """Corpus rows (url, contentType, content, metadata) of WARC or ARC documents."""
    kind = F.col("contentType") if "contentType" in records.columns else F.try_element_at("fields", F.lit("warc.content-type"))
    url = F.col("url") if "url" in records.columns else F.col("id")
    return records.select(url.alias("url"), kind.alias("contentType"), "content", F.col("fields").alias("metadata"))


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, since: tuple[str, str] | None = None, **options: str) -> DataFrame:
    """A query over JDBC, in partitions of a numeric column; since (timestamp column, value) makes a delta import."""
    if since:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", since[0]):
            raise ValueError(f"not a column name: {since[0]!r}")
        value = str(since[1]).replace("'", "''")
        query = f"SELECT * FROM ({query}) q WHERE {since[0]} > '{value}'"
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) t", **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def read_mongo(spark: SparkSession, uri: str, database: str, collection: str, stream: bool = False) -> DataFrame:
    """Needs the public MongoDB connector on the class path; stream=True follows changes."""
    reader = (spark.readStream if stream else spark.read).format("mongodb")
    return reader.options(**{"spark.mongodb.connection.uri": uri, "database": database, "collection": collection}).load()


def suffix_type(name: str) -> tuple[str, str]:
    """(field, Spark type) of a field name with a codec suffix."""
    kinds = {"_b": "tinyint", "_h": "smallint", "_i": "int", "_q": "bigint", "_f": "float", "_d": "double", "_s": "string", "_x": "void", "_j": "string"}
    return (name[:-2], kinds[name[-2:]]) if name[-2:] in kinds else (name, "string")
