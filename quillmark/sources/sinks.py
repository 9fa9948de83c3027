"""Writers: partitioned logs, index tables, dumps and replay folders."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.dates import split_key
from quillmark.operators.documents import field_values


def split_logs(logs: DataFrame, path: str) -> None:
    """Logs by collection, type, date and hour of their own time."""
    date, hour = split_key(F.col("timestamp"))
    logs.withColumn("date", date).withColumn("hour", hour).write.mode("append").partitionBy("collection", "type", "date", "hour").parquet(path)


def split_requests(parsed: DataFrame, path: str, date: str) -> None:
    """Request and other server logs into dated folders, in one pass."""
    rows = parsed.withColumn("stream", F.when(F.lower("kind") == "request", "request").otherwise("server")).withColumn("date", F.lit(date))
    rows.write.mode("append").partitionBy("stream", "date").parquet(path)


def index_rows(docs: DataFrame, mapping: dict[str, str], metadata: bool = True) -> DataFrame:
    """id, text, metadata as meta_<key> entries, and fields from annotations."""
    rows = field_values(mapping, docs)
    keep = ["id", "text", *mapping]
    if metadata and "metadata" in docs.columns:
        rows = rows.withColumn("meta", F.transform_keys("metadata", lambda k, _: F.concat(F.lit("meta_"), k)))
        keep.append("meta")
    return rows.select(*keep)


def write_index(docs: DataFrame, path: str, mapping: dict[str, str]) -> None:
    index_rows(docs, mapping).write.mode("append").parquet(path)


def archives(docs: DataFrame, column: str = "text", per_archive: int = 10_000, names: str = "URL", key: str = "url") -> DataFrame:
    """archive (id), payload (zip of up to per_archive entries), entries (name and key of each): the content dump and its index."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str, bytes]] = []

        def flush() -> pd.DataFrame:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, _, data in held:
                    z.writestr(name, data)
            row = pd.DataFrame({"archive": [uuid.uuid4().hex], "payload": [out.getvalue()], "entries": [[{"name": n, "key": k} for n, k, _ in held]]})
            held.clear()
            return row

        for pdf in batches:
            for k, v in zip(pdf[key], pdf[column], strict=True):
                data = v.encode() if isinstance(v, str) else bytes(v or b"")
                name = {"URL": lambda k=k: str(k).replace("/", "_"), "UUID": lambda: uuid.uuid4().hex, "NUM": lambda: f"{len(held):06d}"}[names]()
                held.append((name, str(k), data))
                if len(held) >= per_archive:
                    yield flush()
        if held:
            yield flush()

    return docs.select(key, column).mapInPandas(task, "archive string, payload binary, entries array<struct<name:string,key:string>>")


def write_libsvm(rows: DataFrame, path: str) -> None:
    """Lines of libsvm_rows as text files."""
    rows.select("line").write.text(path)


def tee(batch: DataFrame, path: str, batch_id: int) -> None:
    """Raw content and parsed documents of a batch into two folders, for replay."""
    raw = [c for c in ("id", "content") if c in batch.columns]
    batch.select(*raw).write.mode("overwrite").parquet(f"{path}/content/batch={batch_id}")
    batch.drop("content").write.mode("overwrite").parquet(f"{path}/documents/batch={batch_id}")
