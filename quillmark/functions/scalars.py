"""Small column functions: maps, keys, weights, decay, JSON and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a half life, history slots, key regions, key delimiter.
HALF_LIFE_MS, HISTORY, REGIONS, DELIMITER = 2_592_000_000, 10, 50, "\x1e"


def extract(items: Column, field: str) -> Column:
    """One field of every element."""
    return F.transform(items, lambda x: x[field])


def add_to_map(m: Column, *pairs: Column) -> Column:
    """m with pairs (key, value, ...) added one after another; later keys win, whatever mapKeyDedupPolicy says."""
    out = F.coalesce(m, F.create_map())
    for key, value in zip(pairs[::2], pairs[1::2], strict=True):
        out = F.map_concat(F.map_filter(out, lambda k, _: k != key), F.create_map(key, value))
    return out


def document_region(doc_id: Column, regions: int = REGIONS) -> Column:
    return (F.crc32(F.encode(doc_id, "UTF-8")) % regions).cast("int")


def document_key(collection: Column, doc_id: Column) -> Column:
    """Salted row key: two hex bytes of region, collection, id, each closed by U+001E."""
    return F.concat(F.lpad(F.hex(document_region(doc_id)), 4, "0"), collection, F.lit(DELIMITER), doc_id, F.lit(DELIMITER))


def from_document_key(key: Column) -> Column:
    return F.struct(F.split(F.substring(key, 5, 1 << 30), DELIMITER)[0].alias("collection"), F.split(F.substring(key, 5, 1 << 30), DELIMITER)[1].alias("id"))


def metric_key(collection: Column, metric: Column, ts: Column) -> Column:
    """Row key in which the newest point of a metric sorts first."""
    salt = F.substring(F.lpad(F.hex(F.crc32(F.encode(collection, "UTF-8"))), 8, "0"), 1, 4)
    return F.concat(salt, collection, F.lit(DELIMITER), metric, F.lit(DELIMITER), F.lpad((F.lit((1 << 63) - 1) - ts).cast("string"), 19, "0"))


def from_metric_key(key: Column) -> Column:
    parts = F.split(F.substring(key, 5, 1 << 30), DELIMITER)
    return F.struct(parts[0].alias("collection"), parts[1].alias("metric"), (F.lit((1 << 63) - 1) - parts[2].cast("long")).alias("ts"))


def position_weight(position: Column) -> Column:
    return 0.5 * F.log1p(position) + 0.5


def reading_weight(ms: Column) -> Column:
    """ln(1 + whole tens of seconds)."""
    return F.log1p(F.floor(F.floor(ms / 1000) / 10))


def decay(value: Column, age_ms: Column, half_life_ms: int = HALF_LIFE_MS, smooth: bool = False) -> Column:
    """value halved once for each half life; in whole steps unless smooth."""
    steps = age_ms / F.lit(half_life_ms)
    return value * F.pow(F.lit(2.0), -(steps if smooth else F.floor(steps)))


def current_boost(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) / 100


def mime_clean(mime: Column) -> Column:
    """Type without its parameters."""
    return F.trim(F.substring_index(mime, ";", 1))


def encode_value(value: Column) -> Column:
    return F.to_json(F.struct(value.alias("v")))


def decode_value(text: Column, kind: str) -> Column:
    return F.from_json(text, f"v {kind}")["v"]


def new_id() -> Column:
    return F.uuid()


def hash_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(DELIMITER, *parts))
