"""The registered queries of the engine, and their SQL.

Each query runs an operator over whole tables. Names begin with the ids of the operator inventory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import dates, html, scalars, text
from quillmark.operators import clicks, documents, logmetrics, metrics, resources, textmining
from quillmark.plans import predicate, search
from quillmark.session import scratch, written
from quillmark.sources import files, logs, sinks
from quillmark.streaming import logs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _flat(df: DataFrame) -> DataFrame:
    """The time tuple as three columns."""
    return df.select("timetuple.*", *[c for c in df.columns if c != "timetuple"])


def _lines(s: SparkSession, df: DataFrame) -> str:
    """The path of a one-column table written as lines."""
    path = f"{scratch(s)}/lines-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def _q(s: SparkSession, d: str) -> DataFrame:
    return logs.event_queries(_table(s, d, "events"))


def _c(s: SparkSession, d: str) -> DataFrame:
    return logs.event_clicks(_table(s, d, "events"))


_ROWS = """'c' || (user_id % 4) AS collection, epoch_us(ts) // 1000 AS timestamp, json_extract_string(props, '$.k') AS k,
  user_id || '-' || CAST(ts AS DATE) AS id, CAST(year(ts) AS INT) AS year, CAST(month(ts) - 1 AS INT) AS month, CAST(day(ts) AS INT) AS date"""
_LOGS = f"""q AS (SELECT {_ROWS}, k AS query, CAST(floor(value) AS INT) AS hits FROM events WHERE event_type = 'view'),
h AS (SELECT * FROM q WHERE hits > 0),
c AS (SELECT {_ROWS}, CAST(event_id % 10 AS INT) AS position FROM events WHERE event_type = 'click')"""
_KEY = "year, month, date, collection"


# ---- log metrics

@_query(f"WITH {_LOGS} SELECT {_KEY}, count(DISTINCT query) AS value FROM h GROUP BY ALL")
def a1_daily_distinct_queries(s, d):
    return _flat(logmetrics.distinct_queries(_q(s, d)))


@_query(f"WITH {_LOGS} SELECT {_KEY}, count(query) AS value FROM h GROUP BY ALL")
def a2_daily_total_queries(s, d):
    return _flat(logmetrics.total_queries(_q(s, d)))


@_query(f"WITH {_LOGS} SELECT {_KEY}, count(query) AS value, 'lt-100-results' AS metric FROM q WHERE hits IS NULL OR hits < 100 GROUP BY ALL")
def a3_low_result_queries(s, d):
    return _flat(logmetrics.low_result_queries(_q(s, d)))


@_query(f"WITH {_LOGS} SELECT {_KEY}, query, max(hits) AS hits FROM h GROUP BY ALL")
def a4_most_hits(s, d):
    return _flat(logmetrics.most_hits(_q(s, d)))


@_query(f"""WITH {_LOGS}, m AS (SELECT {_KEY}, query, CAST(max(hits) AS BIGINT) AS v FROM h GROUP BY ALL),
s AS (SELECT {_KEY}, min(v) AS least, max(v) AS greatest, CAST(ceil(ln(count(*)) + 1) AS INT) AS n_bins FROM m GROUP BY ALL),
b AS (SELECT {_KEY}, least, greatest, n_bins, (v - least) // ((greatest - least + n_bins) // n_bins) AS bin, count(*) AS n FROM m JOIN s USING ({_KEY}) GROUP BY ALL),
r AS (SELECT *, unnest(range(n_bins)) AS i FROM s)
SELECT {_KEY}, r.least, r.greatest, r.n_bins, list(coalesce(b.n, 0) ORDER BY i) AS bins
FROM r LEFT JOIN b USING ({_KEY}) WHERE TRUE AND (b.bin IS NULL OR TRUE) GROUP BY ALL""".replace("USING (year, month, date, collection) WHERE TRUE AND (b.bin IS NULL OR TRUE)", "ON r.year = b.year AND r.month = b.month AND r.date = b.date AND r.collection = b.collection AND r.i = b.bin").replace(f"SELECT {_KEY}, r.least", "SELECT r.year, r.month, r.date, r.collection, r.least"))
def a5_result_histogram(s, d):
    return _flat(logmetrics.result_histogram(_q(s, d)))


_FIRST = f"f AS (SELECT {_KEY}, id, 1.0::DOUBLE / (arg_min(position, (timestamp, position)) + 1) AS rr FROM c GROUP BY ALL)"


@_query(f"WITH {_LOGS}, {_FIRST} SELECT {_KEY}, round(avg(rr), 9) AS value FROM q JOIN f USING ({_KEY}, id) GROUP BY ALL")
def a6_mean_reciprocal_rank(s, d):
    return _flat(logmetrics.mean_reciprocal_rank(_q(s, d), _c(s, d)).withColumn("value", F.round("value", 9)))


@_query(f"WITH {_LOGS}, {_FIRST} SELECT {_KEY}, id, query, timestamp, round(rr, 9) AS rr FROM q JOIN f USING ({_KEY}, id)")
def j1_j2_first_click_join(s, d):
    return _flat(logmetrics.reciprocal_ranks(_q(s, d), _c(s, d)).select("timetuple", "collection", "id", "query", "timestamp", F.round("rr", 9).alias("rr")))


_TOP = "SELECT year, month, date, collection, {0}, count, CAST(row_number() OVER w AS INT) AS rank, CAST(sum(count) OVER (PARTITION BY year, month, date, collection) AS BIGINT) AS total FROM n WINDOW w AS (PARTITION BY year, month, date, collection ORDER BY count DESC, {0}) QUALIFY row_number() OVER w <= 10"


@_query(f"WITH {_LOGS}, n AS (SELECT {_KEY}, query, count(*) AS count FROM h GROUP BY ALL) " + _TOP.format("query"))
def a7_w2_j3_popular_queries(s, d):
    return _flat(logmetrics.popular_queries(_q(s, d)))


@_query(f"WITH {_LOGS}, t AS (SELECT {_KEY}, unnest(regexp_split_to_array(query, '[ \",()*]+')) AS term FROM h), n AS (SELECT {_KEY}, term, count(*) AS count FROM t WHERE term != '' GROUP BY ALL) " + _TOP.format("term"))
def w3_f7_popular_terms(s, d):
    return _flat(logmetrics.popular_terms(_q(s, d)).select("timetuple", "collection", "term", "count", "rank", "total"))


@_query(f"WITH {_LOGS} SELECT {_KEY}, id, query, hits, timestamp FROM q WHERE hits > 0")
def p2_s1_query_log_with_hits(s, d):
    # written as the delimited log, then read by its reader
    path = _lines(s, _q(s, d).select(F.concat_ws(logs.UNIT, "type", "collection", "timestamp", "query", "id", "hits")))
    return _flat(logmetrics.has_hits(logs.read_query_logs(s, path)).select("timetuple", "collection", "id", "query", "hits", "timestamp"))


@_query(f"WITH {_LOGS} SELECT {_KEY}, id, k AS url, position, timestamp FROM c")
def s2_click_log_files(s, d):
    path = _lines(s, _c(s, d).select(F.concat_ws(logs.UNIT, "type", "collection", "timestamp", "id", "url", "position")))
    return _flat(logs.read_click_logs(s, path).select("timetuple", "collection", "id", "url", "position", "timestamp"))


@_query(f"WITH {_LOGS}, l AS (SELECT * FROM q WHERE event_type = 'view') SELECT timestamp AS time, lower('Item ' || k) AS query, id AS request_id, hits, 'Q' AS kind FROM q WHERE hits > 0 UNION ALL SELECT timestamp, NULL, id, position, 'C' FROM c".replace(", l AS (SELECT * FROM q WHERE event_type = 'view')", ""))
def s3_tab_log_files(s, d):
    q = _q(s, d).select(F.concat_ws("\t", F.lit("Q"), "timestamp", F.concat(F.lit("Item "), "query"), "id", "hits"))
    c = _c(s, d).select(F.concat_ws("\t", F.lit("C"), "timestamp", "id", "url", "position"))
    odd = s.createDataFrame([("Q\t1\tfew",), ("",), ("C\tx\ty\tz\t1",)], "value string")
    queries, clicked = logs.read_click_events(s, _lines(s, q.toDF("value").unionByName(c.toDF("value")).unionByName(odd)))
    none = F.lit(None).cast("string").alias("query")
    return queries.select("time", "query", "request_id", "hits", F.lit("Q").alias("kind")).unionByName(clicked.select("time", none, "request_id", F.col("position").alias("hits"), F.lit("C").alias("kind")))


@_query(f"""WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events) SELECT epoch_ms(date_trunc('second', ts)) AS time, 'item ' || k AS query, 1000 AS hits, CASE WHEN event_type = 'click' THEN 'www.' || k END AS doc, CASE WHEN event_type = 'click' THEN CAST(event_id % 10 AS INT) END AS position FROM e""")
def s4_aol_log_files(s, d):
    clicked = F.col("event_type") == "click"
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.col("event_id"), F.lit("\titem "), k, F.lit("\t"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.when(clicked, F.concat(F.lit("\t"), F.col("event_id") % 10, F.lit("\twww."), k)).otherwise(F.lit("")))
    queries, clicks_ = logs.read_aol(s, _lines(s, _table(s, d, "events").select(line)))
    return queries.join(clicks_.select("request_id", "doc", "position"), "request_id", "left").select("time", "query", "hits", "doc", "position")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_mktsegment AS field_3, CAST(c_nationkey AS VARCHAR) AS field_2 FROM customer")
def s5_csv_files(s, d):
    path = f"{scratch(s)}/csv-{uuid.uuid4().hex}"
    _table(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit(", \"x\"")).alias("c_name"), "c_nationkey", "c_mktsegment").write.option("header", True).option("escape", '"').csv(path)
    f = F.col("fields")
    return files.read_csv(s, path, "0=id,1=title", strategy="excel").select("id", F.regexp_replace(f["title"], ', "x"$', "").alias("title"), f["field_3"].alias("field_3"), f["field_2"].alias("field_2"))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ',' || p_type ELSE p_type END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 6.0 ELSE 2.0 END::DOUBLE AS title_boost FROM part")
def s8_s21_solr_xml_files(s, d):
    n, path = F.col("p_partkey"), f"{scratch(s)}/xml-{uuid.uuid4().hex}"

    def given(name: str, value, boost=F.lit(None), update=F.lit(None), null=F.lit(None)):
        return F.struct(value.cast("string").alias("_VALUE"), F.lit(name).alias("_name"), boost.cast("double").alias("_boost"), update.cast("string").alias("_update"), null.cast("boolean").alias("_null"))

    mode = F.when(n % 2 == 0, F.lit("add"))
    fields = F.array(given("id", n), given("title", F.col("p_name"), F.when(n % 3 == 0, 3.0)), given("kind", F.col("p_brand"), update=mode), given("kind", F.col("p_type"), update=mode), given("gone", F.lit("x"), null=F.lit(True)))
    _table(s, d, "part").select(F.lit(2.0).alias("_boost"), fields.alias("field")).write.format("xml").option("rootTag", "add").option("rowTag", "doc").save(path)
    rows = files.read_solr_xml(s, path)
    boost = F.coalesce(F.try_element_at("boosts", F.lit("title")), F.col("boost"))
    return rows.select("id", F.col("fields")["title"].alias("title"), F.col("fields")["kind"].alias("kind"), boost.alias("title_boost"))


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, 'c' AS collection, lang AS field_lang, text, CAST(1 AS INT) AS n FROM documents")
def s11_corpus_documents(s, d):
    t = _table(s, d, "documents")
    note = F.array(F.struct(F.lit("Text").alias("type"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.create_map(F.lit("lang"), F.col("lang")).alias("features")))
    stored = written(t.select(F.col("doc_id").cast("string").alias("url"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), note.alias("annotations")), "corpus")
    rows = files.read_corpus(s, stored.inputFiles()[0].rsplit("/", 1)[0], "c")
    return rows.select("id", "collection", F.col("fields")["lang"].alias("field_lang"), "text", F.size("annotations").alias("n"))


@_query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'doc_failed' WHEN 'view' THEN 'query' ELSE 'doc_succeeded' END AS logtype, CASE event_type WHEN 'view' THEN user_id END AS hits, CASE event_type WHEN 'view' THEN event_id % 100 END AS qtime,
CASE event_type WHEN 'view' THEN '/select' END AS querypath, CASE event_type WHEN 'view' THEN 'a b' || event_id END AS q FROM events""")
def s20_platform_log_lines(s, d):
    e = _table(s, d, "events")
    head = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO  core - "))
    body = F.when(F.col("event_type") == "click", F.concat(F.lit("Doc failed: id="), "event_id")).when(
        F.col("event_type") == "view", F.concat(F.lit("req_type=main path=/select params={q=a+b"), "event_id", F.lit("&rows=10} hits="), "user_id", F.lit(" status=0 QTime="), F.col("event_id") % 100)
    ).otherwise(F.concat(F.lit("Doc succeeded: id="), "event_id"))
    found = logs.parse_platform_log(e.select("event_id", F.concat(head, body).alias("value")))
    return found.select("event_id", "logtype", "hits", "qtime", "querypath", F.try_element_at("attr", F.lit("q")).alias("q"))


@_query("""SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) - 1 AS INT) AS month, CAST(day(ts) AS INT) AS date, CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) AS INT) AS minute,
CAST(floor(second(ts)) AS INT) AS second, CAST(epoch_us(ts) // 1000 % 1000 AS INT) AS millisecond, CAST(dayofweek(ts) + 1 AS INT) AS day_of_week, CAST(day(ts) AS INT) AS day_of_month, CAST(dayofyear(ts) AS INT) AS day_of_year,
CAST((day(ts) - 1 + dayofweek(date_trunc('month', ts))) // 7 + 1 AS INT) AS week_of_month,
CAST(CASE WHEN dayofweek(ts) + dayofyear(make_date(year(ts), 12, 31)) - dayofyear(ts) < 6 THEN 1 ELSE (dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts))) // 7 + 1 END AS INT) AS week_of_year FROM events""")
def f1_epoch_to_calendar(s, d):
    names = ["YEAR", "MONTH", "DATE", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "DAY_OF_WEEK", "DAY_OF_MONTH", "DAY_OF_YEAR", "WEEK_OF_MONTH", "WEEK_OF_YEAR"]
    return _table(s, d, "events").select("event_id", dates.epoch_to_calendar(F.unix_millis(F.col("ts").cast("timestamp")), *names).alias("t")).select("event_id", "t.*")


@_query("SELECT event_id, epoch_ms(date_trunc('second', ts)) AS ms FROM events")
def f2_calendar_to_epoch(s, d):
    names = ["YEAR", "MONTH", "DATE", "HOUR", "MINUTE", "SECOND"]
    return _table(s, d, "events").select("event_id", dates.calendar_to_epoch(dates.epoch_to_calendar(F.unix_millis(F.col("ts").cast("timestamp")), *names), *names).alias("ms"))


@_query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour FROM events")
def f15_t5_split_key(s, d):
    day, hour = dates.split_key(F.unix_millis(F.col("ts").cast("timestamp")))
    return _table(s, d, "events").select("event_id", day.alias("date"), hour.alias("hour"))


@_query("""SELECT event_id, round(0.5 * ln(1 + event_id % 10) + 0.5, 9) AS position_weight, round(ln(1 + (CAST(floor(value * 1000) AS BIGINT) // 1000) // 10), 9) AS reading_weight,
round(value * power(2, -(event_id * 86400000 // 2592000000)), 9) AS decayed FROM events""")
def f9_f10_f12_click_weights(s, d):
    e = _table(s, d, "events")
    return e.select("event_id", F.round(scalars.position_weight(F.col("event_id") % 10), 9).alias("position_weight"), F.round(scalars.reading_weight(F.floor(F.col("value") * 1000)), 9).alias("reading_weight"), F.round(scalars.decay(F.col("value"), F.col("event_id") * 86_400_000), 9).alias("decayed"))


@_query("SELECT event_id, event_type, CAST(props AS VARCHAR) AS props, json_extract_string(props, '$.k') AS k FROM events")
def f16_json_fields(s, d):
    k = scalars.decode_value(scalars.encode_value(F.from_json("props", "k int")), "struct<k:int>")["k"]
    props = scalars.decode_value(scalars.encode_value(F.col("props")), "string")
    return _table(s, d, "events").select("event_id", "event_type", props.alias("props"), k.cast("string").alias("k"))


@_query("SELECT o_orderkey, o_orderstatus || '' AS collection, CAST(o_orderkey AS VARCHAR) AS id FROM orders")
def f6_document_keys(s, d):
    key = scalars.document_key(F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    return _table(s, d, "orders").select("o_orderkey", scalars.from_document_key(key).alias("k")).select("o_orderkey", "k.*")


@_query("SELECT o_orderkey, o_orderstatus AS collection, o_orderpriority AS metric, epoch_ms(o_orderdate) AS ts FROM orders")
def f6_metric_keys(s, d):
    key = scalars.metric_key(F.col("o_orderstatus"), F.col("o_orderpriority"), F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return _table(s, d, "orders").select("o_orderkey", scalars.from_metric_key(key).alias("k")).select("o_orderkey", "k.*")


@_query("SELECT event_id, CAST(user_id AS VARCHAR) AS user, CASE WHEN event_type = 'user' OR event_id % 2 = 0 THEN 1 ELSE 2 END AS size FROM events")
def f5_add_to_map(s, d):
    key = F.when(F.col("event_id") % 2 == 0, F.lit("user")).otherwise(F.col("event_type"))
    m = scalars.add_to_map(F.create_map(key, F.col("value").cast("string")), F.lit("user"), F.col("user_id").cast("string"))
    return _table(s, d, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["user"].alias("user"), F.size("m").alias("size"))


# ---- metric store

_POINTS = "p AS (SELECT o_orderstatus AS collection, 'spend' AS metric, epoch_ms(date_trunc('day', o_orderdate)) AS ts, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY ALL)"


def _points(s: SparkSession, d: str) -> DataFrame:
    o = _table(s, d, "orders").withColumn("timetuple", dates.epoch_to_calendar(F.unix_millis(F.col("o_orderdate").cast("timestamp")), "YEAR", "MONTH", "DATE"))
    return metrics.points(o.groupBy("timetuple", F.col("o_orderstatus").alias("collection")).agg(F.round(F.sum("o_totalprice"), 4).alias("value")), "spend")


@_query(f"WITH {_POINTS} SELECT *, CAST(year(make_timestamp(ts * 1000)) AS INT) AS year, CAST(month(make_timestamp(ts * 1000)) - 1 AS INT) AS month, CAST(day(make_timestamp(ts * 1000)) AS INT) AS date, CAST(dayofweek(make_timestamp(ts * 1000)) + 1 AS INT) AS day_of_week, 0 AS hour FROM p")
def k1_k2_metric_points(s, d):
    return metrics.with_date_dims(_points(s, d))


@_query("""WITH m AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT *, max(n) OVER (PARTITION BY l_returnflag) AS most FROM m),
o AS (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS mode FROM x WHERE n = most GROUP BY ALL)
SELECT l_returnflag, round(sum(l_quantity), 4) AS sum, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 9) AS mean, count(l_quantity) AS cnt, median(l_quantity) AS median, round(CASE WHEN count(*) = 1 THEN 0 ELSE var_samp(l_quantity) END, 6) AS var, any_value(mode) AS mode
FROM lineitem JOIN o USING (l_returnflag) GROUP BY l_returnflag""")
def a8_a15_metric_aggregates(s, d):
    out = metrics.aggregate(_table(s, d, "lineitem"), ["sum", "min", "MAX", "mean", "count", "median", "mode", "var"], "l_returnflag", value="l_quantity")
    return out.withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 9), "var": F.round("var", 6)})


@_query(f"WITH {_POINTS} SELECT collection, metric, max(ts) AS ts, arg_max(value, ts) AS value FROM p GROUP BY ALL")
def w6_latest_metric(s, d):
    return metrics.latest(_points(s, d))


@_query(f"WITH {_POINTS} SELECT * FROM p WHERE collection = 'F' AND ts >= 852076800000 AND ts < 883612800000")
def w7_metric_range(s, d):
    return metrics.metric_range(_points(s, d), "F", "spend", 852_076_800_000, 883_612_800_000)


@_query(f"WITH {_POINTS} SELECT * FROM p")
def k1_metric_store(s, d):
    path = f"{scratch(s)}/metrics-{uuid.uuid4().hex}"
    metrics.put(_points(s, d), path)
    metrics.put(_points(s, d).withColumn("value", F.col("value") - 1), path)
    return metrics.load(s, path)


@_query("SELECT 'c' AS collection, 'm' AS metric, CAST(1000 AS BIGINT) AS ts, 2.5::DOUBLE AS value")
def k2_put_metric(s, d):
    path = f"{scratch(s)}/metrics-{uuid.uuid4().hex}"
    metrics.put_metric(s, path, "c", 1000, "m", 2.5)
    return metrics.load(s, path)


@_query(f"WITH {_POINTS} SELECT collection, ts, map([metric], [value])['spend'] AS spend, CAST(1 AS INT) AS n FROM p")
def k1b_wide_metrics(s, d):
    return metrics.wide(_points(s, d)).select("collection", "ts", F.col("metrics")["spend"].alias("spend"), F.size("metrics").alias("n"))


@_query(f"WITH {_LOGS} SELECT collection, type, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS date, strftime(make_timestamp(timestamp * 1000), '%H') AS hour, count(*) AS n FROM (SELECT collection, 'Q' AS type, timestamp FROM q UNION ALL SELECT collection, 'C', timestamp FROM c) GROUP BY ALL")
def k6_split_log_folders(s, d):
    path = f"{scratch(s)}/split-{uuid.uuid4().hex}"
    sinks.split_logs(_q(s, d).select("collection", "type", "timestamp", "id").unionByName(_c(s, d).select("collection", "type", "timestamp", "id")), path)
    stored = s.read.schema("timestamp long, id string, collection string, type string, date string, hour string").parquet(path)
    return stored.groupBy("collection", "type", "date", "hour").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT CASE event_type WHEN 'view' THEN 'request' ELSE 'server' END AS stream, CAST(user_id AS VARCHAR) AS user, count(*) AS n FROM events GROUP BY ALL")
def k7_f14_request_log_folders(s, d):
    path = f"{scratch(s)}/requests-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "view", "Request").otherwise(F.col("event_type"))
    lines = _table(s, d, "events").select(F.concat(F.lit("["), kind, F.lit("] user="), "user_id", F.lit(" none= x=1")).alias("value"))
    sinks.split_requests(logs.parse_request_log(lines).withColumn("user", F.col("fields")["user"]).drop("fields"), path, "2024-01-01")
    return s.read.parquet(path).groupBy("stream", "user").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_POINTS} SELECT round(sum(value), 2) AS sum, count(*) AS cnt, round(median(value), 4) AS median, count(*) AS series FROM p WHERE collection = 'O'")
def a15_metric_request(s, d):
    out = metrics.Analytics(_points(s, d)).metric(metrics.MetricRequest("O", "spend", aggregates=["sum", "count", "median"]))
    a = F.col("aggregates")
    return out.select(F.round(a["sum"], 2).alias("sum"), a["cnt"].cast("long").alias("cnt"), F.round(a["median"], 4).alias("median"), F.size("series").cast("long").alias("series"))


@_query(f"WITH {_POINTS} SELECT collection, metric, 694224000000 + ((ts - 694224000000) // 2592000000) * 2592000000 AS ts, round(avg(value), 6) AS value FROM p WHERE ts >= 694224000000 GROUP BY ALL")
def p17b_resampled_metric(s, d):
    return metrics.resample(_points(s, d), 694_224_000_000, step=2_592_000_000).withColumn("value", F.round("value", 6))


@_query(f"WITH {_POINTS} SELECT DISTINCT collection, metric FROM p WHERE collection != 'P'")
def k5_metrics_without_collection(s, d):
    return metrics.Analytics(metrics.without_collection(_points(s, d), "P")).supported_metrics()


# ---- predicates

@_query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 300000 OR NOT (o_orderpriority IN ('1-URGENT', '2-HIGH')))")
def p5_p13_predicate(s, d):
    return predicate.query(_table(s, d, "orders"), "fields=o_orderkey,o_orderstatus,o_totalprice&o_orderstatus=F&(o_totalprice>300000|!o_orderpriority.in(1-URGENT,2-HIGH))")


@_query("SELECT * FROM lineitem WHERE NOT coalesce(l_returnflag = 'N', FALSE) AND l_quantity <= 3 AND l_discount >= 0.05")
def p6_p7_predicate_not_equal(s, d):
    return predicate.query(_table(s, d, "lineitem"), "l_returnflag!=N&l_quantity<=3&l_discount>=0.05")


@_query("SELECT c_custkey, c_name AS name, c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 OR c_acctbal IS NULL")
def p17_category_projection(s, d):
    c = _table(s, d, "customer").select("c_custkey", F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("inner"), "c_acctbal").alias("info"))
    found = predicate.query(c, "fields=c_custkey,info/inner/*&(info/c_acctbal>9000|info/c_acctbal=null)")
    return found.select("c_custkey", "`info/inner`.*")


@_query("""WITH o AS (SELECT o_custkey, epoch_ms(o_orderdate) AS t, o_totalprice AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-01-01'),
b AS (SELECT o_custkey, 820454400000 + (t - 820454400000) // 2592000000 * 2592000000 AS t, avg(v) AS v FROM (SELECT o_custkey, t, max(v) AS v FROM o GROUP BY ALL) GROUP BY ALL)
SELECT c_custkey, count(t) AS n, round(coalesce(sum(v), 0), 2) AS total FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) LEFT JOIN b ON c_custkey = o_custkey GROUP BY ALL""")
def p17b_series_interval(s, d):
    o = _table(s, d, "orders").groupBy("o_custkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t")).agg(F.max("o_totalprice").alias("v"))
    series = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("spend"))
    found = predicate.query(series, "fields=c_custkey,spend[820454400000,883612800000,2592000000]")
    return found.select("c_custkey", F.size("spend").cast("long").alias("n"), F.round(F.aggregate(F.map_values("spend"), F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@_query("SELECT p_partkey, n FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS n FROM part) WHERE n = 0")
def p9_empty_category(s, d):
    some = F.when(F.col("p_partkey") % 3 != 0, F.create_map(F.lit("a"), F.col("p_name"))).otherwise(F.when(F.col("p_partkey") % 2 == 0, F.create_map().cast("map<string,string>")))
    rows = _table(s, d, "part").withColumn("info", some)
    return predicate.query(rows, "info.isEmpty()").select("p_partkey", F.coalesce(F.nullif(F.size("info"), F.lit(-1)), F.lit(0)).alias("n"))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_custkey < 1000 AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0)")
def p18_p17_key_predicate(s, d):
    c = _table(s, d, "customer")
    return predicate.query(c, "fields=c_custkey,c_name&c_custkey<1000&(c_mktsegment=BUILDING|c_acctbal<0)", keys={"c_nationkey": 7})


@_query("SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_brand = 'Brand#13' OR p_retailprice < 910")
def p20_predicate_builder(s, d):
    b = predicate.Builder().property("p_size").gt(40).and_().property("p_brand").equals("Brand#13").or_().property("p_retailprice").lt(910)
    p = _table(s, d, "part")
    return p.where(b.column(p.schema)).select("p_partkey", "p_size")


@_query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), []) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j8_sub_resources(s, d):
    out = resources.with_children(_table(s, d, "customer"), _table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), {"c_custkey": "o_custkey"}, "orders")
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), scalars.extract(F.col("orders"), "o_orderkey").alias("orders"))


@_query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j9_enriched(s, d):
    nation = _table(s, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = _table(s, d, "region").withColumnRenamed("r_regionkey", "c_regionkey")
    return resources.enriched(_table(s, d, "customer"), [(nation, ["c_nationkey"]), (region, ["c_regionkey"])], ["c_custkey", "n_name"])


# ---- documents

@_query("SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https://.+') AND NOT regexp_full_match(url, '.*example[.]com.*')")
def p21_p22_document_filter(s, d):
    pages = _table(s, d, "pages").withColumn("metadata", F.create_map(F.lit("host"), F.try_parse_url("url", F.lit("HOST"))))
    return documents.DocumentFilter(url="https://.+", skip={"host": ".*example[.]com"}).apply(pages).select("page_id", "url")


@_query("SELECT doc_id, md5(text) AS signature, doc_id != max(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents")
def u3_signature_tag(s, d):
    return documents.dedupe(_table(s, d, "documents"), "tag").select("doc_id", "signature", "duplicate")


@_query("SELECT max(doc_id) AS doc_id FROM documents GROUP BY text")
def u3_signature_overwrite(s, d):
    return documents.dedupe(_table(s, d, "documents"), "overwrite").select("doc_id")


@_query("SELECT c_custkey AS id, c_name || ' ' || c_mktsegment AS title, CAST(c_acctbal AS DOUBLE) AS attr_c_acctbal, 'web' AS source, c_nationkey AS nation FROM customer")
def f18_f19_u4_field_mapping(s, d):
    m = documents.FieldMapping({"C_CUSTKEY": "id", "c_name": "title", "c_mktsegment": "title", "c_nationkey": "nation"}, types={"id": "LONG", "attr_c_acctbal": "DOUBLE", "nation": "INT"}, literals={"source": "web"})
    return m.apply(_table(s, d, "customer"))


def _document_rows(s: SparkSession, d: str) -> DataFrame:
    t = _table(s, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("collection"), F.lit(1).cast("long").alias("version"), "text")


@_query("""SELECT CAST(doc_id AS VARCHAR) AS id, source AS collection, CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 2 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 2 THEN 'kept' ELSE md5(text) END AS text FROM documents""".replace("WHEN doc_id % 3 = 2 THEN 'kept' ", "").replace(" OR doc_id % 3 = 2", ""))
def k3_versioned_put(s, d):
    stored = _document_rows(s, d).withColumn("text", F.md5(F.encode("text", "UTF-8")))
    # a third is put with the stored version, a third with a stale one
    n = F.col("id").cast("long") % 3
    batch = stored.where(n != 1).withColumn("version", F.when(n == 0, 1).otherwise(0).cast("long")).withColumn("text", F.lit("new"))
    return documents.upsert(stored, batch)


@_query("SELECT count(*) FILTER (doc_id % 3 = 0) AS DOCS_ADDED, count(*) FILTER (doc_id % 3 = 2) AS PUT_FAILED FROM documents")
def k3_put_counts(s, d):
    stored = _document_rows(s, d)
    n = F.col("id").cast("long") % 3
    return documents.put_counts(stored, stored.where(n != 1).withColumn("version", F.when(n == 0, 1).otherwise(0).cast("long")))


@_query("SELECT doc_id FROM documents WHERE source != 'src0'")
def k4_without_collection(s, d):
    return documents.without_collection(_table(s, d, "documents").withColumnRenamed("source", "collection"), "src0").select("doc_id")


@_query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src1' AND CAST(doc_id AS VARCHAR) >= '2' AND CAST(doc_id AS VARCHAR) < '7'")
def s24_p24_range_scan(s, d):
    return documents.range_scan(_document_rows(s, d), "src1", "2", "7").select("id")


@_query("SELECT CASE WHEN doc_id % 2 = 0 AND text != '' THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'failed' WHEN text = '' THEN 'failed' ELSE 'extract' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def p25_extraction_status(s, d):
    t = _table(s, d, "documents")
    rows = t.select(F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 5 != 0, F.encode("text", "UTF-8")).alias("content"))
    return documents.extraction_status(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j12_removed_since(s, d):
    return documents.removed_since(_table(s, d, "documents"), _table(s, d, "labels"), "doc_id").select("doc_id")


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS collection, CASE WHEN doc_id % 7 = 0 THEN 'delete' ELSE 'put' END AS op FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def t6_change_feed(s, d):
    before = _document_rows(s, d)
    n = F.col("id").cast("long")
    after = before.where(n % 7 != 0).withColumn("text", F.when(n % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return documents.change_feed(before, after)


@_query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def w9_page(s, d):
    return documents.page(_table(s, d, "part"), 40, 20, F.col("p_retailprice").desc(), "p_partkey").select("p_partkey", "p_name")


@_query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|hot) .*[rt]$')")
def p26_column_search(s, d):
    return documents.search_column(_table(s, d, "part"), "p_name", "^(red|hot) .*[rt]$").select("p_partkey", "p_name")


@_query()
def f23_html_extract(s, d):
    return html.extracted(_table(s, d, "pages"), "page_id", "html")


_RULES = [("/en/1", False), ("/en", True), ("/fr", False)]


@_query("SELECT page_id, CASE WHEN starts_with(p, '/en/1') THEN FALSE WHEN starts_with(p, '/en') THEN TRUE WHEN starts_with(p, '/fr') THEN FALSE ELSE TRUE END AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)")
def f24_robots(s, d):
    return _table(s, d, "pages").select("page_id", html.robots_allowed(F.col("url"), _RULES).alias("allowed"))


@_query()
def p23_k8_j7_annotations(s, d):
    t = _table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    docs = t.withColumn("annotations", F.array().cast(f"array<{documents.ANNOTATION}>"))
    both = documents.merge_annotations(docs, textmining.annotated(docs, textmining.token_annotator))
    rows = both.withColumn("inside", documents.annotations("Token", "string", "[a-z]+", (0, 40)))
    return documents.field_values({"words": "Token.string"}, rows).select("id", F.size("inside").alias("n_inside"), F.size("words").alias("n_words"))


# ---- text

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


@_query(f"SELECT doc_id, len(w) AS n, CAST(len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS INT) AS n_pairs FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)")
def f11_word_pairs(s, d):
    t = textmining.tokenised(_table(s, d, "documents"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n"), F.size(F.array_distinct(text.ngrams(F.col("tokens"), 2))).alias("n_pairs"))


@_query("""SELECT p_partkey, CASE WHEN ends_with(w, 'ss') OR ends_with(w, 'us') OR ends_with(w, 'is') THEN w WHEN regexp_matches(w, '^.{2,}ies$') THEN left(w, len(w) - 3) || 'y' WHEN regexp_matches(w, '^.+xes$') THEN left(w, len(w) - 3) || 'x'
WHEN regexp_matches(w, '^.+ches$') THEN left(w, len(w) - 4) || 'ch' WHEN regexp_matches(w, '^.+shes$') THEN left(w, len(w) - 4) || 'sh' WHEN ends_with(w, 'sses') THEN left(w, len(w) - 4) || 'ss' WHEN regexp_matches(w, '^.{2,}s$') THEN left(w, len(w) - 1) ELSE w END AS stem
FROM (SELECT p_partkey, p_name || 's' AS w FROM part)""")
def f20_plural_stem(s, d):
    return _table(s, d, "part").select("p_partkey", text.PLURALS.column(F.concat("p_name", F.lit("s"))).alias("stem"))


_TF = f"t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), g AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM f GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents)"


@_query(f"""WITH {_TF}, w AS (SELECT doc_id, term, tf, df, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM f JOIN g USING (term), n WHERE cf >= 2 AND df * 100 <= 99 * n)
SELECT doc_id, term, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w""".replace("(n + 1) / (df + 1)", "(n + 1.0::DOUBLE) / (df + 1)"))
def a21_m4_tfidf(s, d):
    t = textmining.tokenised(_table(s, d, "documents"))
    return textmining.tfidf(textmining.term_frequencies(t), t.count(), norm=2).withColumn("weight", F.round("weight", 9))


def _x(v: str) -> str:
    return f"CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END"


@_query(f"""WITH t AS (SELECT {_WORDS.format('text')} AS w FROM documents), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM t),
c AS (SELECT phrase, count(*) AS n, split_part(phrase, ' ', 1) AS a, split_part(phrase, ' ', 2) AS b FROM p GROUP BY phrase),
m AS (SELECT phrase, n, CAST(n AS DOUBLE) AS k11, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) - n AS k12, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) - n AS k21, CAST(sum(n) OVER () AS DOUBLE) AS nn FROM c),
k AS (SELECT *, nn - k11 - k12 - k21 AS k22 FROM m WHERE n >= 2),
l AS (SELECT phrase, n, greatest(0, 2 * ({_x('nn')} - ({_x('(k11 + k12)')}) - ({_x('(k21 + k22)')}) + {_x('nn')} - ({_x('(k11 + k21)')}) - ({_x('(k12 + k22)')}) - {_x('nn')} + ({_x('k11')}) + ({_x('k12')}) + ({_x('k21')}) + ({_x('k22')}))) AS llr FROM k)
SELECT phrase, n, round(llr, 3) AS llr FROM l WHERE llr >= 1""")
def m8_k9_collocations(s, d):
    return textmining.collocations(textmining.tokenised(_table(s, d, "documents"))).withColumn("llr", F.round("llr", 3))


@_query(f"""WITH {_TF}, w AS (SELECT doc_id, term, tf * (ln((n + 1.0::DOUBLE) / (df + 1)) + 1) AS w FROM f JOIN g USING (term), n WHERE cf >= 2 AND df * 100 <= 99.0::DOUBLE * n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)
SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.w * b.w), 9) AS score FROM u a JOIN u b ON a.term = b.term AND a.doc_id % 50 = 0 AND a.doc_id != b.doc_id GROUP BY ALL HAVING sum(a.w * b.w) > 0""")
def m6_row_similarity(s, d):
    t = textmining.tokenised(_table(s, d, "documents"))
    # a stated query set against all rows
    return textmining.text_similarity(t, t.where("doc_id % 50 = 0")).withColumn("score", F.rint(F.col("score") * 1e9) / 1e9)


@_query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id)
SELECT a, b, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def m6_m14_similar_vectors(s, d):
    e = _table(s, d, "embeddings")
    return textmining.vector_similarity(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding").withColumn("score", F.round("score", 6))


@_query()
def m5_m13_kmeans(s, d):
    e = textmining.array_features(_table(s, d, "embeddings"), "embedding")
    return textmining.cluster_documents(textmining.clustered(e.select("vec_id", "features")), "vec_id")


@_query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents")
def m7_row_ids(s, d):
    return textmining.row_ids(_table(s, d, "documents"))


@_query()
def k12_j11_libsvm(s, d):
    t = textmining.tokenised(_table(s, d, "documents"))
    w = textmining.tfidf(textmining.term_frequencies(t), t.count(), max_df_percent=50)
    return textmining.libsvm_rows(w, _table(s, d, "labels"), label="quality")


# ---- clicks: queries are 'item <k> group <k % 7>', so that they have word pairs

def _click_logs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("query").cast("long")
    q = _q(s, d).where("hits > 0").select(F.col("timestamp").alias("time"), F.concat(F.lit("item "), "query", F.lit(" group "), k % 7).alias("query"), F.col("id").alias("request_id"), "hits")
    c = _c(s, d).select(F.col("timestamp").alias("time"), F.col("id").alias("request_id"), F.col("url").alias("doc"), "position")
    return q, c


_CLICK = f"""WITH {_LOGS}, qq AS (SELECT id, ['item ' || query, query || ' group', 'group ' || (CAST(query AS BIGINT) % 7)] AS g FROM h),
s AS (SELECT id, unnest(list_distinct(g)) AS term FROM qq),
dw AS (SELECT *, lead(timestamp) OVER (PARTITION BY id ORDER BY timestamp, position, k) - timestamp AS dwell FROM c),
cw AS (SELECT id, k AS doc, position, coalesce(dwell, avg(dwell) OVER (PARTITION BY id), 0) AS dwell FROM dw),
p AS (SELECT doc, term, 0.5 * ln(1 + position) + 0.5 AS pos, ln(1 + floor(floor(dwell / 1000) / 10)) AS time FROM cw JOIN s USING (id) UNION ALL SELECT '*', term, 0.5, 0.0 FROM s)"""


@_query(_CLICK + " SELECT term, round(sum(pos), 6) AS pos FROM p GROUP BY term HAVING sum(pos) >= 1.0")
def s3_a17_term_weights(s, d):
    return clicks.term_weights(clicks.prepare(*_click_logs(s, d))).withColumn("pos", F.round("pos", 6))


@_query(_CLICK + " SELECT doc, term, round(sum(pos), 6) AS pos, round(sum(time), 6) AS time FROM p WHERE doc != '*' GROUP BY ALL")
def w4_a18_doc_terms(s, d):
    return clicks.doc_term_weights(clicks.prepare(*_click_logs(s, d))).withColumns({"pos": F.round("pos", 6), "time": F.round("time", 6)})


@_query()
def a18_collapsed_terms(s, d):
    return clicks.aggregate_docs(clicks.prepare(*_click_logs(s, d)))


@_query(_CLICK + """, t AS (SELECT doc, term, sum(pos) AS pos FROM p WHERE doc != '*' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos DESC, term) AS n FROM t QUALIFY n <= 20)
SELECT doc, round(sum(pos) / 100 * 1.25, 6) AS pos_boost, count(*) AS n_terms FROM k GROUP BY doc""")
def a20_w5_f13_boost_merge(s, d):
    now = clicks.current_boosts(clicks.aggregate_docs(clicks.prepare(*_click_logs(s, d)), collapsed=False))
    # the state of 60 days ago, when the same clicks were all there was: a quarter of it is left
    before = clicks.merge_boosts(now, 1_700_000_000_000)
    out = clicks.merge_boosts(now.unionByName(before), 1_700_000_000_000 + 60 * 86_400_000)
    return out.select("doc", F.round("pos_boost", 6).alias("pos_boost"), F.size("terms").cast("long").alias("n_terms"))


@_query(f"WITH {_LOGS}, x AS (SELECT id, count(*) AS n FROM c GROUP BY id) SELECT h.id AS request_id, h.timestamp AS time, coalesce(n, 0) AS n_clicks FROM h LEFT JOIN x USING (id)")
def j4_t10_sessions(s, d):
    return clicks.sessions(*_click_logs(s, d)).select("request_id", "time", F.size("clicks").cast("long").alias("n_clicks"))


@_query(_CLICK + """, r AS (SELECT doc, term, sum(pos) AS pos FROM p WHERE doc != '*' GROUP BY doc, term), o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos DESC, term) AS n FROM r), t AS (SELECT doc, sum(pos) AS pos FROM o WHERE n <= 20 GROUP BY doc)
SELECT p_partkey, round(pos / 100, 6) AS click_val, CASE WHEN pos IS NULL THEN NULL ELSE 1 END AS click FROM part LEFT JOIN t ON CAST(p_partkey AS VARCHAR) = doc""")
def j10_q30_click_boost_join(s, d):
    b = clicks.current_boosts(clicks.aggregate_docs(clicks.prepare(*_click_logs(s, d)), collapsed=False))
    out = clicks.join_boosts(_table(s, d, "part").withColumn("id", F.col("p_partkey").cast("string")), b)
    return out.select("p_partkey", F.round("click_val", 6).alias("click_val"), "click")


# ---- search

_INDEXES: dict[tuple[str, str], DataFrame] = {}


def _docs(s: SparkSession, d: str) -> DataFrame:
    """The index of the documents, made once in a session, as an index is."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = search.indexed(_table(s, d, "documents").withColumn("title", F.substring("text", 1, 60)), "text", "title")
    return _INDEXES[key]


_IDX = "x AS (SELECT doc_id, lang, source, n_chars, text, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t FROM documents)"


def _search(name: str, query: str, sql: str, **options) -> None:
    def run(s, d):
        return search.matches(_docs(s, d), query, search.Options(**options)).select("doc_id")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_IDX} SELECT doc_id FROM x WHERE {sql}"


def _has(w: str) -> str:
    return f"list_contains(t, '{w}')"


def _any(test: str) -> str:
    return f"len(list_filter(t, lambda w: {test})) > 0"


_PAIR = "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{0}' AND len(list_filter(range({2}), lambda k: {3})) > 0)) > 0"
_search("q3_boolean", "+the -for with", f"{_has('the')} AND NOT {_has('for')}")
_search("q3_all_negative", "-the -der", f"NOT {_has('the')} AND NOT {_has('der')}")
_search("q4_default_and", "for with", f"{_has('for')} AND {_has('with')}")
_search("q2_keywords", "for OR der AND NOT with", f"({_has('for')} OR {_has('der')}) AND NOT {_has('with')}")
_search("q5_at_least", "(the der les with)~2", f"CAST({_has('the')} AS INT) + CAST({_has('der')} AS INT) + CAST({_has('les')} AS INT) + CAST({_has('with')} AS INT) >= 2")
_search("q5_at_least_percent", "(the der les with)~75%", f"CAST({_has('the')} AS INT) + CAST({_has('der')} AS INT) + CAST({_has('les')} AS INT) + CAST({_has('with')} AS INT) >= 3")
_search("q6_fields", "lang:de source:src1", "lang = 'de' AND source = 'src1'")
_search("q8_phrase", '"of the"', _PAIR.format("of", "the", 1, "t[i + 1] = 'the'"))
_search("q8_phrase_slop", '"of the"~2', _PAIR.format("of", "the", 5, "i - 1 + k >= 1 AND t[i - 1 + k] = 'the'"))
_search("q9_before", "der BEFORE:2 die", _PAIR.format("der", "die", 3, "t[i + 1 + k] = 'die'"))
_search("q9_after", "die AFTER:2 der", _PAIR.format("der", "die", 3, "t[i + 1 + k] = 'die'"))
_search("q9_span_not", '("of the" -"the in") BEFORE:5 and', "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of' AND t[i + 1] = 'the' AND coalesce(t[i + 2], '') != 'in' AND len(list_filter(range(6), lambda k: t[i + 2 + k] = 'and')) > 0)) > 0")
_search("q9_chain", "of BEFORE:0 the BEFORE:3 and", "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of' AND t[i + 1] = 'the' AND len(list_filter(range(4), lambda k: t[i + 2 + k] = 'and')) > 0)) > 0")
_search("q8_phrase_gap", '"of * the"', _PAIR.format("of", "the", 1, "t[i + 2] = 'the'"))
_search("q12_fuzzy_words", "off-thee~1", "len(list_filter(range(1, len(t) + 1), lambda i: levenshtein(t[i], 'off') <= 1 AND levenshtein(t[i + 1], 'thee') <= 1)) > 0")
_search("q12_fuzzy_words_anywhere", "off-thee~1", "len(list_filter(t, lambda w: levenshtein(w, 'off') <= 1)) > 0 AND len(list_filter(t, lambda w: levenshtein(w, 'thee') <= 1)) > 0", span_fuzzy=False)
_search("q16_stem", "stem: ones", f"({_has('one')} OR {_has('ones')})")
_search("q16_nostem", "nostem: ones", _has("ones"), stem=True)
_search("q16_synonyms", "syn: forx", f"({_has('for')} OR {_has('with')})", synonyms=text.Synonyms("forx => for, with"), expand=False)
_search("q16_nosyn", "nosyn: for", _has("for"), synonyms=text.Synonyms("for, with"))
_search("q16_at_least", "atLeast:2 the der les", f"CAST({_has('the')} AS INT) + CAST({_has('der')} AS INT) + CAST({_has('les')} AS INT) >= 2")
_search("q19_like_terms", "like:(for der nothere)", f"({_has('for')} OR {_has('der')} OR {_has('nothere')})")
_search("q6_all_fields", "ALL:attion", "list_contains(t, 'attion') OR list_contains(regexp_extract_all(lower(strip_accents(left(text, 60))), '[\\p{L}\\p{N}]+'), 'attion')")
_search("q9_near", "les near:3 la", "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'les' AND len(list_filter(range(9), lambda k: i - 4 + k >= 1 AND k != 4 AND t[i - 4 + k] = 'la')) > 0)) > 0")
_search("q10_wildcards", "ther* ?nd", f"{_any('starts_with(w, $$ther$$)')} AND {_any('regexp_full_match(w, $$.nd$$)')}")
_search("q11_fuzzy", "there~1", _any("abs(len(w) - 5) <= 1 AND levenshtein(w, 'there') <= 1"))
_search("q13_range", "n_chars:[500 TO 1000}", "n_chars >= 500 AND n_chars < 1000")
_search("q14_relational", "n_chars > 9000", "n_chars > 9000")
_search("q18_hyphen", "of-the", f"({_PAIR.format('of', 'the', 1, 't[i + 1] = $$the$$')} OR {_has('ofthe')})")
_search("q21_empty_query", "", "TRUE")


@_query("WITH r AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01') SELECT * FROM r")
def q13_f26_date_range(s, d):
    o = _table(s, d, "orders")
    return search.matches(o, "o_orderdate:[1995-03 TO 1995-03-31]", search.Options(fields=("o_orderkey",))).select("o_orderkey")


_C_SQL = "power(128 / (1 + ln(10000000.25 / 1.25)), 1.0::DOUBLE / 9999999)"


@_query(f"""WITH {_IDX}, f AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS n, len(list_filter(t, lambda w: w = 'thereon')) AS f, len(list_filter(t, lambda w: w = 'the')) AS g FROM x),
k AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (f > 0) AS DOUBLE) AS a, CAST(count(*) FILTER (g > 0) AS DOUBLE) AS b FROM f),
i AS (SELECT sqrt((1 + ln((n + 0.25) / (a + 0.25))) * power({_C_SQL}, n - a)) AS ia, sqrt((1 + ln((n + 0.25) / (b + 0.25))) * power({_C_SQL}, n - b)) AS ib FROM k)
SELECT doc_id, round((CASE WHEN f > 0 THEN ln(1 + f - 0.06) / ln(1.94) * ia * 2 ELSE 0 END + CASE WHEN g > 0 THEN ln(1 + g - 0.06) / ln(1.94) * ib ELSE 0 END) * 10 / sqrt(n + 99), 6) AS score FROM f, i WHERE f > 0 OR g > 0""")
def q22_q15_score(s, d):
    out = search.search(_docs(s, d), "thereon^2 OR the", search.Options(relevance=False))
    return out.select("doc_id", F.round("score", 6).alias("score"))


def _dismax(field: str, name: str) -> str:
    return f"{name} AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS n, len(list_filter(t, lambda w: w = 'attion')) AS f FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents({field})), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents)), k{name} AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (f > 0) AS DOUBLE) AS a FROM {name}), s{name} AS (SELECT doc_id, CASE WHEN f > 0 THEN ln(1 + f - 0.06) / ln(1.94) ELSE 0 END * sqrt((1 + ln((k.n + 0.25) / (k.a + 0.25))) * power({_C_SQL}, k.n - k.a)) * 10 / sqrt(x.n + 99) AS s FROM {name} x, k{name} k)"


@_query(f"WITH {_dismax('text', 'a')}, {_dismax('left(text, 60)', 'b')} SELECT doc_id, round(greatest(sa.s, sb.s) + 0.01 * (sa.s + sb.s - greatest(sa.s, sb.s)), 6) AS score FROM sa JOIN sb USING (doc_id) WHERE sa.s > 0 OR sb.s > 0")
def q7_two_fields(s, d):
    found = search.search(_docs(s, d), "attion", search.Options(fields=("text", "title")))
    return found.select("doc_id", F.round("score", 6).alias("score"))


@_query(f"WITH {_IDX} SELECT doc_id, CAST(n_chars AS DOUBLE) * 2 AS score FROM x WHERE {_has('ntea')}")
def q6_function_score(s, d):
    rows = _docs(s, d).where(F.array_contains("_t_text", "ntea"))
    return search.search(rows, "_val_:n_chars^2", search.Options(relevance=False)).select("doc_id", "score")


@_query(f"""WITH {_IDX}, f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM x) GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY ALL), n AS (SELECT count(*) AS n FROM x),
w AS (SELECT doc_id, term, tf, df, tf * (ln(greatest(1, n // (df + 1))) + 1) AS weight FROM f JOIN g USING (term), n WHERE tf >= 2 AND df >= 5)
SELECT doc_id, term, tf, df, round(weight, 9) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 25""")
def w11_q26_interesting_terms(s, d):
    return search.interesting_terms(_docs(s, d), "text", "doc_id").select("doc_id", "term", "tf", "df", F.round("weight", 9).alias("weight"))


@_query(f"""WITH {_IDX}, f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM x) GROUP BY ALL), g AS (SELECT term, ln(greatest(1, (SELECT count(*) FROM x) // (count(*) + 1))) + 1 AS idf FROM f GROUP BY ALL),
r AS (SELECT term, sum(CASE WHEN doc_id % 50 = 0 THEN 0.75 / 10 ELSE -0.15 / 10 END * tf * greatest(idf - 1, 1e-6)) AS b FROM f JOIN g USING (term) WHERE doc_id < 500 AND (doc_id % 50 = 0 OR doc_id % 50 = 1) GROUP BY term)
SELECT term, round(b + CASE WHEN term = 'the' THEN 2.0 ELSE 0 END, 6) AS boost FROM r""")
def q24_rocchio(s, d):
    docs = _docs(s, d)
    total = docs.count()
    tf = docs.where("doc_id < 500").select("doc_id", F.explode("_t_text").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = docs.select(F.explode(F.array_distinct("_t_text")).alias("term")).groupBy("term").agg((F.log(F.greatest(F.lit(1), F.floor(F.lit(total) / (F.count(F.lit(1)) + 1)))) + 1).alias("idf"))
    rows = tf.join(idf, "term")
    found = search.rocchio(rows.where("doc_id % 50 = 0"), rows.where("doc_id % 50 = 1"), (10, 10), original={"the": 2.0})
    return found.withColumn("boost", F.round("boost", 6))


@_query(f"""WITH {_IDX}, f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM x) GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY ALL),
w AS (SELECT term FROM f JOIN g USING (term) WHERE doc_id = 1 AND len(term) >= 4 AND term NOT IN ({", ".join(repr(w) for w in text.ENGLISH_STOP_WORDS)}) ORDER BY tf * (ln(greatest(1, (SELECT count(*) FROM x) // (df + 1))) + 1) DESC, term LIMIT 15)
SELECT DISTINCT doc_id FROM f JOIN w USING (term)""")
def q19_like_document(s, d):
    return search.search(_docs(s, d), 'like:"1"', search.Options(relevance=False), key="doc_id").select("doc_id")


@_query()
def q17_ranked_search(s, d):
    return search.search(_docs(s, d), "of the with").select("doc_id", "score")


@_query()
def q24_q25_feedback(s, d):
    return search.with_feedback(_docs(s, d), "therefore OR with OR thereon", "doc_id").select("doc_id", "score")


@_query(f"WITH {_IDX} SELECT doc_id FROM x WHERE (lang = 'de') OR (lang = 'en' AND {_has('with')})")
def q27_role_filter(s, d):
    docs = _docs(s, d)
    return docs.where(search.role_filter(docs.schema, ["a", "b", "z"], {"a": ["lang:de"], "b": ["lang:en", "with"]}, ["-*:*"])).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source != 'src1'")
def q28_acl_filter(s, d):
    docs = _table(s, d, "documents").withColumns({"acl": F.array("lang"), "deny": F.array("source")})
    return docs.where(search.fail_closed(lambda: search.acl_filter(["en", "fr", "src1"]))).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE FALSE")
def q29_fail_closed(s, d):
    def broken():
        raise PermissionError("no directory")

    return _table(s, d, "documents").where(search.fail_closed(broken)).select("doc_id")


@_query("SELECT doc_id, regexp_replace(text, '(?i)(^|[^\\p{L}\\p{N}])(thereon)($|[^\\p{L}\\p{N}])', '\\1<b>\\2</b>\\3', 'g') AS highlight FROM documents")
def q32_highlight(s, d):
    return search.highlighted(_table(s, d, "documents"), "thereon", mode="HIGHLIGHT").select("doc_id", "highlight")


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select(F.explode(F.array_distinct("_t_text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


_DICT = f"{_IDX}, v AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM x) GROUP BY term)"


@_query(f"WITH {_DICT} SELECT term, df, CAST(levenshtein(term, 'therer') AS INT) AS edits FROM v WHERE levenshtein(term, 'therer') BETWEEN 1 AND 2 ORDER BY edits, df DESC, term LIMIT 5")
def q33_spelling(s, d):
    return search.suggestions(_dictionary(s, d), "therer")


@_query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def q34_facets(s, d):
    return search.facets(_table(s, d, "documents"), "lang")


@_query(f"WITH {_DICT} SELECT term, df FROM v WHERE starts_with(term, 'then') ORDER BY df DESC, term LIMIT 10")
def q34_autocomplete(s, d):
    return search.autocomplete(_dictionary(s, d), "then")


@_query("SELECT doc_id, CASE doc_id WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS place FROM documents WHERE doc_id != 5")
def q35_elevation(s, d):
    return search.elevated(_table(s, d, "documents").withColumn("score", F.lit(1.0)), "doc_id", [7, 3], [5]).select("doc_id", "place")


@_query("SELECT doc_id, CASE WHEN lang = 'de' THEN 3.0 ELSE 1.0 END::DOUBLE AS score, CASE WHEN lang = 'fr' THEN 'x' END AS tag FROM documents WHERE source != 'src2'")
def q31_rules(s, d):
    docs = _docs(s, d).withColumn("score", F.lit(1.0))
    return search.apply_rules(docs, [("lang:de", "boost", {"factor": 3.0}), ("source:src2", "hide", {}), ("lang:fr", "set", {"column": "tag", "value": "x"})]).select("doc_id", "score", "tag")


@_query()
def q19_w11_more_like(s, d):
    return search.top(search.more_like(_docs(s, d), "doc_id", 1), "doc_id", 10).select("doc_id", "score")


# ---- streams: the batch result is the oracle

def _streamed(s: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Runs a stream over the events to its end; the result is read from what its batches wrote."""
    folder = f"{scratch(s)}/stream-{uuid.uuid4().hex}"
    # a file source reads folders, so the table is put into one first
    source = written(_table(s, d, "events"), "events")
    path = source.inputFiles()[0].rsplit("/", 1)[0]
    df = s.readStream.schema(source.schema).parquet(path)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    streams.start(make(df), write, f"{folder}/checkpoint").awaitTermination()
    return s.read.schema(schema).parquet(f"{folder}/out").select(*[x.split()[0] for x in schema.split(",")])


@_query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour FROM events WHERE event_type IN ('view', 'click')")
def t1_t5_stream_split(s, d):
    def make(df: DataFrame) -> DataFrame:
        return streams.by_event_hour(df.where("event_type IN ('view', 'click')").withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp")))).select("event_id", "date", "hour")

    return _streamed(s, d, make, "event_id long, date string, hour string")


@_query("WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)")
def t4_stream_windows(s, d):
    return _streamed(s, d, lambda df: streams.windowed_counts(df, "ts", "1 hour", "1 hour", "event_type"), "start timestamp, event_type string, n long")
