"""The log pipeline as streams: consume, split by hour, daily counts, sessions, change feed.

State is bounded by watermarks (an extension); sinks are idempotent per batch, so a restarted query does not write twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from quillmark.functions.dates import split_key

INTERVAL = "20 minutes"


def kafka(spark: SparkSession, servers: str, topics: list[str], **options: str) -> DataFrame:
    """value, topic and time of messages; needs the public Kafka connector. A checkpoint keeps the offsets; the earliest are taken when there is none."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", **options}).load()
    return raw.select(F.col("value").cast("string").alias("value"), "topic", F.col("timestamp").alias("ingested"))


def tail(spark: SparkSession, path: str, files_per_batch: int = 100, archive: str | None = None) -> DataFrame:
    """Lines of a log folder as they arrive, at most so many files a batch; finished files move to archive."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(path)


def verified(messages: DataFrame, value: str = "value", checksum: str = "crc") -> DataFrame:
    """Messages whose CRC-32 agrees."""
    return messages.where(F.crc32(F.encode(value, "UTF-8")) == F.col(checksum))


def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, interval: str = INTERVAL, mode: str = "append") -> StreamingQuery:
    """Runs a stream with a batch writer: once over all that is there, or every interval."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def by_ingest_hour(messages: DataFrame) -> DataFrame:
    """date, hour of ingest (UTC)."""
    return messages.withColumn("date", F.date_format("ingested", "yyyy-MM-dd")).withColumn("hour", F.date_format("ingested", "HH"))


def by_event_hour(logs: DataFrame) -> DataFrame:
    date, hour = split_key(F.col("timestamp"))
    return logs.withColumn("date", date).withColumn("hour", hour)


def hourly_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch into its own id folder under date and hour; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "hour", "id").parquet(path)

    return write


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp in the session's zone, as watermarks need it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, ts: str = "ts", length: str = "1 hour", late: str = "1 hour", *keys: str) -> DataFrame:
    """Counts of tumbling windows; rows later than the watermark are left out."""
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, length).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding_counts(events: DataFrame, ts: str = "ts", length: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour", *keys: str) -> DataFrame:
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, user: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), user, "n")


def reading_sessions(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """request_id, query, clicks when the watermark passes: a query and its clicks in either order.

    rows: ts, request_id, kind (Q or C), value (query or document). Requests without a query are left out, as in batch.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        query, clicks = state.get if state.exists else (None, [])
        clicks = list(clicks)
        if state.hasTimedOut:
            state.remove()
            if query is not None:
                yield pd.DataFrame({"request_id": [key[0]], "query": [query], "clicks": [clicks]})
            return
        latest = 0
        for pdf in batches:
            for kind, value, ts in pdf.sort_values(["ts", "value"])[["kind", "value", "ts"]].itertuples(index=False):
                latest = max(latest, int(ts.timestamp() * 1000))
                if kind == "Q":
                    query = value if query is None else query
                else:
                    clicks.append(value)
        state.update((query, clicks))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1) + 1)

    return rows.withWatermark("ts", late).groupBy("request_id").applyInPandasWithState(step, "request_id string, query string, clicks array<string>", "query string, clicks array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def change_writer(path: str, counts: dict[str, int]) -> Callable[[DataFrame, int], None]:
    """Appends put and delete keys of each batch (collection, id, op) to a change table, and adds up the counters."""

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"changes-{batch_id}")
        rows = batch.observe(seen, F.count_if(F.col("op") == "put").alias("puts"), F.count_if(F.col("op") == "delete").alias("deletes"))
        rows.select("collection", "id", "op").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for k, v in seen.get.items():
            counts[k] = counts.get(k, 0) + v
        counts["last_batch"] = batch_id

    return write


class Counters(StreamingQueryListener):
    """Rows in, batches and failures of the session's streams."""

    def __init__(self):
        self.values = {"rows": 0, "batches": 0, "failed": 0}

    def reset(self) -> None:
        self.values = dict.fromkeys(self.values, 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.values["rows"] += event.progress.numInputRows
        self.values["batches"] += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.values["failed"] += 1


class EventBuffer:
    """Holds click event lines while buffering is on; switching it off writes them, and so does holding `limit` of them."""

    def __init__(self, write: Callable[[list[str]], None], limit: int = 100_000):
        self.write, self.held, self.on, self.limit = write, [], False, limit

    def record(self, *lines: str) -> None:
        self.held.extend(lines)
        if not self.on or len(self.held) >= self.limit:
            self.flush()

    def buffering(self, on: bool) -> None:
        self.on = on
        if not on:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.write(self.held)
            self.held = []


def gauges(docs: DataFrame) -> DataFrame:
    """Collections and documents, without the collection of logs."""
    return docs.where("collection != 'logs'").agg(F.countDistinct("collection").alias("collections"), F.count(F.lit(1)).alias("documents"))


def query_log_line(ts: int, query: str, request_id: str, hits: int) -> str:
    return f"Q\t{ts}\t{query}\t{request_id}\t{hits}"


def click_log_line(ts: int, request_id: str, doc: str, position: int) -> str:
    return f"C\t{ts}\t{request_id}\t{doc}\t{position}"
