"""Document tables: filters, versions, signatures, field mapping and annotations.

A document is id, collection, version, contentType, text, content, boost, annotations
(array of type, start, end, features), fields, boosts, calculated. A read mask is a
selection of columns, which Parquet prunes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillmark.functions.scalars import mime_clean

ANNOTATION = "struct<type:string,start:bigint,end:bigint,features:map<string,string>>"
DOCUMENT = f"id string, collection string, version long, contentType string, text string, content binary, boost double, annotations array<{ANNOTATION}>, fields map<string,string>, boosts map<string,double>, calculated map<string,string>"
#: Columns of each bit of a read mask.
MASK = {1: ["text"], 2: ["content"], 4: ["fields", "boosts"], 8: ["calculated"], 16: ["annotations"]}
INFO = ["id", "collection", "version", "contentType", "boost"]


def masked(docs: DataFrame, mask: int = 31) -> DataFrame:
    return docs.select(*[c for c in INFO + [c for bit, cs in MASK.items() if mask & bit for c in cs] if c in docs.columns])


@dataclass
class DocumentFilter:
    """URL, MIME and metadata patterns (whole values), and a limit of content length.

    With keep patterns a document without metadata goes, with skip patterns it stays; a
    missing key fails AND. Keep and skip cannot be mixed.
    """

    url: str | None = None
    mime: str | None = None
    max_length: int = -1
    keep: dict[str, str] = field(default_factory=dict)
    skip: dict[str, str] = field(default_factory=dict)
    mode: str = "AND"

    def __post_init__(self):
        if self.keep and self.skip:
            raise ValueError("keep and skip patterns cannot be mixed")

    def required(self) -> bool:
        return bool(self.url or self.mime or self.max_length >= 0 or self.keep or self.skip)

    def column(self, columns: list[str]) -> Column:
        parts = []
        if self.url is not None:
            parts.append(_whole(F.col("url"), self.url))
        if self.mime is not None:
            parts.append(F.col("contentType").isNull() | _whole(F.col("contentType"), self.mime))
        if self.max_length >= 0 and "content" in columns:
            parts.append(F.coalesce(F.octet_length("content"), F.lit(0)) <= self.max_length)
        if patterns := self.keep or self.skip:
            tests = [_whole(F.try_element_at("metadata", F.lit(k)), p) for k, p in patterns.items()]
            hit = reduce(Column.__and__ if self.mode.upper() == "AND" else Column.__or__, tests)
            parts.append(hit if self.keep else ~hit)
        return reduce(Column.__and__, parts) if parts else F.lit(True)

    def apply(self, docs: DataFrame, counts: Observation | None = None) -> DataFrame:
        """The documents that pass; counts gets kept and skipped in the same pass."""
        passed = self.column(docs.columns)
        if counts is not None:
            docs = docs.observe(counts, F.count_if(passed).alias("kept"), F.count_if(~passed).alias("skipped"))
        return docs.where(passed)


def _whole(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"^(?:{pattern})$"), F.lit(False))


def has_text(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND text != ''")


def without_text(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NULL OR text = ''")


def extraction_status(docs: DataFrame) -> DataFrame:
    """status: skipped (text is there), failed (no text, no content) or extract."""
    status = F.when(F.coalesce(F.length("text") > 0, F.lit(False)), "skipped").when(F.coalesce(F.octet_length("content") > 0, F.lit(False)), "extract").otherwise("failed")
    return docs.withColumn("status", status)


def annotations(kind: str | None = None, feature: str | None = None, value: str | None = None, within: tuple[int, int] | None = None, column: str = "annotations") -> Column:
    """Annotations of a type, with a feature whose name and value match, inside a span."""

    def test(a: Column) -> Column:
        ok = F.lit(True)
        if kind is not None:
            ok = ok & (a["type"] == kind)
        if feature is not None:
            name = f"^(?:{feature})$"
            ok = ok & F.exists(F.map_entries(a["features"]), lambda e: e["key"].rlike(name) & (F.lit(True) if value is None else e["value"].rlike(f"^(?:{value})$")))
        if within is not None:
            ok = ok & (a["start"] >= within[0]) & (a["end"] <= within[1])
        return F.coalesce(ok, F.lit(False))

    return F.filter(column, test)


def sorted_annotations(column: str = "annotations") -> Column:
    """By start, type, end, number of features."""
    key = F.transform(column, lambda a: F.struct(a["start"].alias("s"), a["type"].alias("t"), a["end"].alias("e"), F.size(F.map_keys(a["features"])).alias("n"), F.to_json(a["features"]).alias("f")))
    return F.transform(F.sort_array(key), lambda k: F.struct(k["t"].alias("type"), k["s"].alias("start"), k["e"].alias("end"), F.from_json(k["f"], "map<string,string>").alias("features")))


def _feature(name: str):
    return lambda a: F.try_element_at(a["features"], F.lit(name))


def field_values(mapping: dict[str, str], docs: DataFrame) -> DataFrame:
    """Index columns from annotations: {'person': 'Person.string', 'place': 'Place'}; without feature the covered text."""
    out = docs
    for name, target in mapping.items():
        kind, _, feature = target.partition(".")
        found = annotations(kind)
        if feature:
            value = F.transform(found, _feature(feature))
        else:
            value = F.transform(found, lambda a: F.substring(F.col("text"), (a["start"] + 1).cast("int"), (a["end"] - a["start"]).cast("int")))
        out = out.withColumn(name, F.array_compact(value))
    return out


def by_type(mapping: dict[str, str]) -> dict[str, dict[str, str]]:
    """{type: {feature or *: field}} of a field mapping."""
    out: dict[str, dict[str, str]] = {}
    for name, target in mapping.items():
        kind, _, feature = target.partition(".")
        out.setdefault(kind, {})[feature or "*"] = name
    return out


def merge_annotations(docs: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """docs with the annotations of found (key, annotations) added; a document without any keeps its own."""
    more = found.select(key, F.col("annotations").alias("_more"))
    none = F.array().cast(f"array<{ANNOTATION}>")
    both = F.concat(F.coalesce("annotations", none), F.coalesce("_more", none))
    return docs.join(more, key, "left").withColumn("annotations", both).drop("_more")


def upsert(stored: DataFrame, new: DataFrame, overwrite: bool = False, key: tuple[str, ...] = ("collection", "id")) -> DataFrame:
    """Stored documents after a batch of puts, version + 1 on write.

    A put counts if its version is the stored one, or if nothing is stored, or on overwrite; of several the
    one of the greatest version, then text, counts. Rejected puts leave the stored row.
    """
    keys = list(key)
    order = Window.partitionBy(*keys).orderBy(F.col("version").desc_nulls_last(), F.col("text").desc_nulls_last())
    puts = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    old = stored.select(*keys, F.col("version").alias("_stored"))
    checked = puts.join(old, keys, "left").withColumn("_ok", F.lit(overwrite) | F.col("_stored").isNull() | F.coalesce(F.col("_stored") == F.col("version"), F.lit(False)))
    accepted = checked.where("_ok").withColumn("version", F.coalesce("_stored", "version", F.lit(0)) + 1)
    return stored.join(accepted.select(*keys), keys, "left_anti").unionByName(accepted.select(*stored.columns))


def put_counts(stored: DataFrame, new: DataFrame, overwrite: bool = False, key: tuple[str, ...] = ("collection", "id")) -> DataFrame:
    """DOCS_ADDED and PUT_FAILED of a batch."""
    old = stored.select(*key, F.col("version").alias("_stored"))
    ok = F.lit(overwrite) | F.col("_stored").isNull() | F.coalesce(F.col("_stored") == F.col("version"), F.lit(False))
    return new.join(old, list(key), "left").agg(F.count_if(ok).alias("DOCS_ADDED"), F.count_if(~ok).alias("PUT_FAILED"))


def without_collection(docs: DataFrame, collection: str) -> DataFrame:
    return docs.where(~F.col("collection").eqNullSafe(F.lit(collection)))


def range_scan(docs: DataFrame, collection: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Documents of a collection in order of id, from first up to but without last."""
    rows = docs.where(F.col("collection") == collection)
    if first is not None:
        rows = rows.where(F.col("id") >= first)
    if last is not None:
        rows = rows.where(F.col("id") < last)
    return rows.orderBy("id")


def dedupe(docs: DataFrame, mode: str = "off", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Signature dedup: off, tag (adds signature and duplicate) or overwrite (the last document of a signature stays).

    A signature's last document is found by a grouped maximum, so copies are never gathered in one task.
    """
    if mode == "off":
        return docs
    if mode not in ("tag", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    signed = docs.withColumn("signature", F.md5(F.coalesce(F.col(text), F.lit(""))))
    ends = signed.groupBy("signature").agg(F.max(key).alias("_last"))
    joined = signed.join(ends, "signature").withColumn("duplicate", F.col(key) != F.col("_last")).drop("_last")
    return joined if mode == "tag" else joined.where("NOT duplicate").drop("signature", "duplicate")


def merged_values(values: Column) -> Column:
    """Distinct values in order, joined by a space."""
    return F.array_join(F.array_distinct(values), " ")


@dataclass
class FieldMapping:
    """Renaming and typing of crawled fields.

    A name is looked up in mappings without regard to case (a blank target drops the field), then in
    schema; else it becomes prefix_<name> with other characters as _, in lower case; else default; else it stays.
    types: STRING, INT, LONG, FLOAT, DOUBLE, DATE; a value that does not parse is dropped. Literals are added.
    """

    mappings: dict[str, str] = field(default_factory=dict)
    schema: frozenset[str] = frozenset()
    prefix: str | None = "attr"
    default: str | None = None
    types: dict[str, str] = field(default_factory=dict)
    literals: dict[str, str] = field(default_factory=dict)
    single: frozenset[str] = frozenset()

    def target(self, name: str) -> str | None:
        low = {k.lower(): v for k, v in self.mappings.items()}
        if name.lower() in low:
            return low[name.lower()].strip() or None
        if name in self.schema:
            return name
        if self.prefix:
            return f"{self.prefix}_{re.sub(r'[^A-Za-z0-9_]', '_', name).lower()}"
        return self.default or name

    def _typed(self, name: str, c: Column) -> Column:
        kind = self.types.get(name, "STRING")
        return {
            "STRING": lambda: c.cast("string"),
            "INT": lambda: c.try_cast("double").try_cast("int"),
            "LONG": lambda: c.try_cast("double").try_cast("long"),
            "FLOAT": lambda: c.try_cast("float"),
            "DOUBLE": lambda: c.try_cast("double"),
            "DATE": lambda: F.coalesce(F.try_to_timestamp(c), F.timestamp_millis(c.try_cast("long"))),
        }[kind]()

    def apply(self, df: DataFrame) -> DataFrame:
        """df with mapped columns; columns that share a target are merged, or coalesced if the target is single or typed."""
        sources: dict[str, list[str]] = {}
        for c in df.columns:
            if (t := self.target(c)) is not None:
                sources.setdefault(t, []).append(c)
        out = []
        for t, cs in sources.items():
            if len(cs) > 1 and t not in self.single and t not in self.types:
                out.append(merged_values(F.array_compact(F.array(*[F.col(f"`{c}`").cast("string") for c in cs]))).alias(t))
            else:
                out.append(F.coalesce(*[self._typed(t, F.col(f"`{c}`")) for c in reversed(cs)]).alias(t))
        return df.select(*out, *[self._typed(k, F.lit(v)).alias(k) for k, v in self.literals.items() if k not in sources])

    def apply_map(self, fields: Column) -> Column:
        """The same renaming for a map column whose keys are not known beforehand."""
        low = F.create_map(*[F.lit(x) for k, v in self.mappings.items() for x in (k.lower(), v)]) if self.mappings else None
        known = F.array(*[F.lit(x) for x in sorted(self.schema)]).cast("array<string>")

        def rename(k: Column, _: Column) -> Column:
            own = F.concat(F.lit(f"{self.prefix}_"), F.lower(F.regexp_replace(k, "[^A-Za-z0-9_]", "_"))) if self.prefix else F.lit(self.default) if self.default else k
            own = F.when(F.array_contains(known, k), k).otherwise(own)
            return F.coalesce(F.try_element_at(low, F.lower(k)), own) if low is not None else own

        return F.map_filter(F.transform_keys(fields, rename), lambda k, _: F.trim(k) != "")


def search_column(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column holds the pattern."""
    return df.where(F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def with_role(users: DataFrame, role: str) -> DataFrame:
    return users.where(F.array_contains("roles", role))


def page(df: DataFrame, start: int, rows: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(rows)


def page_info(total: int, start: int, rows: int) -> dict[str, int]:
    """Page number (from 1), page count (rounded up), first and last row."""
    rows = max(1, rows)
    return {"page": start // rows + 1, "pages": -(-total // rows), "first": min(start, total), "last": min(start + rows, total)}


def removed_since(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Stored documents that the batch does not hold."""
    return stored.join(batch.select(key), key, "left_anti")


def string_hash(text: Column) -> Column:
    """h = 31 h + c over the UTF-16 units of a text, modulo 2 ** 32, as an unsigned number."""
    word = 1 << 32

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        pair = (h * 31 + 0xD800 + F.shiftright(code - 0x10000, 10)) * 31 + 0xDC00 + (code - 0x10000).bitwiseAND(F.lit(1023))
        return F.when(code < 0x10000, h * 31 + code).otherwise(pair) % word

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def shard(doc_id: Column, shards: int) -> Column:
    """Shard by the upper 31 bits of the id's string hash."""
    return (F.shiftright(string_hash(doc_id), 1) % shards).cast("int")


def change_feed(before: DataFrame, after: DataFrame, watched: tuple[str, ...] = ("text", "annotations", "fields"), key: tuple[str, ...] = ("collection", "id")) -> DataFrame:
    """Keys put (new or changed in a watched column) or deleted between two states."""
    digest = F.xxhash64(*[F.to_json(F.struct(c)) for c in watched if c in after.columns])
    a = before.select(*key, digest.alias("_a"))
    b = after.select(*key, digest.alias("_b"))
    rows = a.join(b, list(key), "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return rows.select(*key, F.when(F.col("_b").isNull(), "delete").otherwise("put").alias("op"))


def clean_types(docs: DataFrame) -> DataFrame:
    return docs.withColumn("contentType", mime_clean(F.col("contentType")))
