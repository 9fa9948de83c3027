"""Resources with sub-resources, enrichment by providers, and nested request bodies."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Each parent with an array of its children (empty if none); one shuffle of the children, no loop over parents."""
    keys = list(on.values())
    grouped = children.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.sort_array(F.collect_list(F.struct(*children.columns))).alias(name))
    match = [parents[p] == grouped[f"_k{i}"] for i, p in enumerate(on)]
    joined = parents.join(grouped, match, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return joined.withColumn(name, F.coalesce(name, F.array().cast(dict(joined.dtypes)[name])))


def enriched(rows: DataFrame, providers: list[tuple[DataFrame, list[str]]], wanted: list[str]) -> DataFrame:
    """rows left-joined to those providers (table, key columns) that supply a wanted property; others are not read."""
    for table, keys in providers:
        supplied = [c for c in table.columns if c in wanted and c not in keys and c not in rows.columns]
        if supplied:
            rows = rows.join(table.select(*keys, *supplied), keys, "left")
    return rows.select(*wanted)


def flat_body(text: str) -> tuple[dict[str, Any], dict[str, str]]:
    """(properties as Category/name, request info) of a JSON body; arrays of plain values become sorted distinct lists."""
    out: dict[str, Any] = {}
    info: dict[str, str] = {}

    def walk(node: Any, path: str) -> None:
        for k, v in node.items():
            name = f"{path}/{k}" if path else k
            if not path and k == "RequestInfo" and isinstance(v, dict):
                info.update({a: str(b) for a, b in v.items()})
            elif isinstance(v, dict):
                walk(v, name)
            elif isinstance(v, list) and all(isinstance(x, dict) for x in v) and v:
                out[name] = v
            elif isinstance(v, list):
                out[name] = sorted({str(x) for x in v})
            else:
                out[name] = v

    body = json.loads(text) if text.strip() else {}
    for item in body if isinstance(body, list) else [body]:
        walk(item, "")
    return out, info


def flat_columns(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs of a parsed body as columns Category/name."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(separator.join(p)) for p in leaves(df.schema, ())])
