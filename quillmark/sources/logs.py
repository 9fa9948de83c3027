"""Readers for query, click and platform logs, and the mapping of the fixed test events onto them.

Lines are parsed with built-in functions, so a log of any size is read in one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.dates import epoch_to_calendar

UNIT = "\x1f"
QUERY_LOG = "type string, collection string, timestamp long, query string, id string, hits int"
CLICK_LOG = "type string, collection string, timestamp long, id string, url string, position int"


def with_time_tuple(logs: DataFrame) -> DataFrame:
    """logs with timetuple (year, month from 0, date) in UTC."""
    return logs.withColumn("timetuple", epoch_to_calendar(F.col("timestamp"), "YEAR", "MONTH", "DATE"))


def clean(logs: DataFrame, *needed: str) -> DataFrame:
    """Rows in which all needed fields are set."""
    return logs.dropna(subset=list(needed))


def read_query_logs(spark: SparkSession, path, cleaned: bool = True) -> DataFrame:
    """U+001F-delimited query log; cleaned=False keeps rows with missing fields, as the reference does."""
    logs = spark.read.schema(QUERY_LOG).option("sep", UNIT).option("quote", "").csv(path)
    return with_time_tuple(clean(logs, "collection", "timestamp", "query", "id") if cleaned else logs)


def read_click_logs(spark: SparkSession, path, cleaned: bool = True) -> DataFrame:
    logs = spark.read.schema(CLICK_LOG).option("sep", UNIT).option("quote", "").csv(path)
    return with_time_tuple(clean(logs, "collection", "timestamp", "id", "position") if cleaned else logs)


def parse_click_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, clicks) from tab-delimited lines in column value.

    Queries: Q, time, query, request id, hits; rows of under 5 fields or with 0 hits go.
    Clicks: C, time, request id, document, position.
    """
    rows = lines.select(F.split("value", "\t").alias("f")).where(F.size("f") >= 5)

    def field(i: int):
        return F.col("f")[i]

    queries = rows.where(field(0) == "Q").select(
        field(1).try_cast("long").alias("time"), F.lower(field(2)).alias("query"), field(3).alias("request_id"), field(4).try_cast("int").alias("hits")
    )
    clicks = rows.where(field(0) == "C").select(
        field(1).try_cast("long").alias("time"), field(2).alias("request_id"), field(3).alias("doc"), field(4).try_cast("int").alias("position")
    )
    return queries.where("hits > 0"), clicks.where("time IS NOT NULL AND position IS NOT NULL")


def user_of(request_id):
    """The part before ~, or none."""
    return F.when(F.contains(request_id, F.lit("~")), F.substring_index(request_id, "~", 1)).otherwise(F.lit("none"))


def request_id(user, ts, query):
    """user~hex8(ts)hash(query)."""
    return F.concat(user, F.lit("~"), F.lower(F.lpad(F.hex(ts), 8, "0")), F.hash(query).cast("string"))


def read_click_events(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    return parse_click_events(spark.read.text(path))


def parse_aol(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, clicks) from user, query, time, rank, url lines: every line is a query of 1000 hits, one with a rank also a click."""
    f = F.split("value", "\t")
    rows = lines.select(
        f[0].alias("user"), f[1].alias("query"), F.unix_millis(F.try_to_timestamp(f[2], F.lit("yyyy-MM-dd HH:mm:ss"))).alias("time"), F.get(f, 3).try_cast("int").alias("rank"), F.get(f, 4).alias("doc")
    ).where("time IS NOT NULL")
    rows = rows.withColumn("request_id", request_id(F.col("user"), F.col("time"), F.col("query")))
    clicks = rows.where("rank IS NOT NULL").select("time", "request_id", "doc", F.col("rank").alias("position"))
    return rows.select("time", "query", "request_id", F.lit(1000).alias("hits")), clicks


def read_aol(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    return parse_aol(spark.read.text(path))


def parse_request_log(lines: DataFrame) -> DataFrame:
    """kind and key=value pairs of lines like [kind] a=1 b=2."""
    body = F.regexp_extract("value", r"^\[(\S+?)\]\s(.*)$", 2)
    keys = F.regexp_extract_all(body, F.lit(r"(\w+)=(\S+)?\s?"), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(r"(\w+)=(\S+)?\s?"), F.lit(2))
    return lines.select(F.regexp_extract("value", r"^\[(\S+?)\]\s(.*)$", 1).alias("kind"), F.map_from_arrays(keys, values).alias("fields"), "value").where("kind != ''")


def parse_platform_log(lines: DataFrame) -> DataFrame:
    """Log type (doc_succeeded, doc_failed, query) of platform log lines, with path, params, handler, hits and qtime of queries.

    Lines of other kinds, or whose first 27 characters show no level of INFO or above, go.
    """
    v = F.col("value")
    level = F.substring(v, 1, 27).rlike(" (INFO|WARN|ERROR|FATAL) ")
    kind = F.when(F.contains(v, F.lit("Doc failed: ")), "doc_failed").when(F.contains(v, F.lit("Doc succeeded: ")), "doc_succeeded").when(F.contains(v, F.lit("req_type=main")), "query")
    query = F.col("logtype") == "query"

    def cut(pattern: str):
        return F.when(query, F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")))

    rows = lines.withColumn("logtype", kind).where(level & F.col("logtype").isNotNull())
    rows = rows.withColumn("querypath", cut(r"path=(\S*) ")).withColumn("params", cut(r"params=\{(.*?)\} "))
    rows = rows.withColumn("attr", F.transform_values(F.str_to_map("params", F.lit("&"), F.lit("=")), lambda _, x: F.url_decode(x)))
    handler = F.when(F.col("querypath").isin("/select", "/select/"), F.try_element_at("attr", F.lit("qt"))).otherwise(F.col("querypath"))
    return rows.withColumns({"handler": handler, "q_length": F.length(F.try_element_at("attr", F.lit("q"))), "hits": cut(r"hits=(\S*) ").try_cast("long"), "qtime": cut(r"QTime=(\S*)").try_cast("long")})


def event_queries(events: DataFrame) -> DataFrame:
    """Query log rows from the test events: views, with hits = floor(value). The mapping is ours."""
    e = events.where("event_type = 'view'")
    rows = e.select(
        F.lit("Q").alias("type"),
        F.concat(F.lit("c"), F.col("user_id") % 4).alias("collection"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.get_json_object("props", "$.k").alias("query"),
        F.concat(F.col("user_id"), F.lit("-"), F.to_date("ts")).alias("id"),
        F.floor("value").cast("int").alias("hits"),
    )
    return with_time_tuple(rows)


def event_clicks(events: DataFrame) -> DataFrame:
    """Click log rows from the test events: clicks, with position = event_id % 10. The mapping is ours."""
    e = events.where("event_type = 'click'")
    rows = e.select(
        F.lit("C").alias("type"),
        F.concat(F.lit("c"), F.col("user_id") % 4).alias("collection"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat(F.col("user_id"), F.lit("-"), F.to_date("ts")).alias("id"),
        F.get_json_object("props", "$.k").alias("url"),
        (F.col("event_id") % 10).cast("int").alias("position"),
    )
    return with_time_tuple(rows)
