"""Metric time series: points, storage, ranges, and aggregates requested by name.

A point is (collection, metric, ts, value). Points are stored by collection and
metric, so a request reads its own folders only, and all its aggregates come from one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.dates import calendar_field, calendar_to_epoch

PARTS = ["collection", "metric"]


def points(rows: DataFrame, metric: str, value: str = "value") -> DataFrame:
    """Points from rows keyed by (timetuple, collection); ts is the start of the day."""
    return rows.select("collection", F.lit(metric).alias("metric"), calendar_to_epoch(F.col("timetuple"), "YEAR", "MONTH", "DATE").alias("ts"), F.col(value).cast("double").alias("value"))


def with_date_dims(p: DataFrame) -> DataFrame:
    """Points with year, month (from 0), date, day_of_week and hour of ts."""
    ts = F.col("ts")
    return p.withColumns({"year": calendar_field(ts, "YEAR"), "month": calendar_field(ts, "MONTH"), "date": calendar_field(ts, "DATE"), "day_of_week": calendar_field(ts, "DAY_OF_WEEK"), "hour": calendar_field(ts, "HOUR")})


def put(p: DataFrame, path: str) -> None:
    """Appends points with their date dimensions."""
    with_date_dims(p).write.mode("append").partitionBy(*PARTS).parquet(path)


def put_metric(spark: SparkSession, path: str, collection: str, ts: int, metric: str, value: float) -> None:
    put(spark.createDataFrame([(collection, metric, ts, float(value))], "collection string, metric string, ts long, value double"), path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored points; of several at one time the greatest value counts."""
    return spark.read.parquet(path).groupBy(*PARTS, "ts").agg(F.max("value").alias("value"))


def without_collection(p: DataFrame, collection: str) -> DataFrame:
    return p.where(~F.col("collection").eqNullSafe(F.lit(collection)))


def wide(p: DataFrame) -> DataFrame:
    """All metrics of a collection and time as one map."""
    return p.groupBy("collection", "ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def metric_range(p: DataFrame, collection: str, metric: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Points with start <= ts < stop, newest first."""
    p = p.where((F.col("collection") == collection) & (F.col("metric") == metric))
    if start is not None:
        p = p.where(F.col("ts") >= start)
    if stop is not None:
        p = p.where(F.col("ts") < stop)
    return p.orderBy(F.col("ts").desc())


def latest(p: DataFrame) -> DataFrame:
    """Newest point of each metric."""
    return p.groupBy(*PARTS).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))




AGGREGATES = {
    "sum": lambda v: F.sum(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "mean": lambda v: F.avg(v),
    "count": lambda v: F.count(v),
    "median": lambda v: F.percentile(v, F.lit(0.5)),
    "var": lambda v: F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.var_samp(v)),
}
#: Names under which results are given, where they differ from the request.
RESULT_NAMES = {"count": "cnt"}


def check_names(names: list[str]) -> list[str]:
    """Lower-case names; an unknown one raises."""
    low = [x.lower() for x in names]
    if bad := [x for x in low if x not in AGGREGATES and x != "mode"]:
        raise ValueError(f"unknown aggregates: {bad}")
    return low


def modes(p: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """All most frequent values of each group, ascending."""
    counts = p.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(most, [*keys, "n"]).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("mode"))


def aggregate(p: DataFrame, names: list[str], *keys: str, value: str = "value") -> DataFrame:
    """The named aggregates of each group in one pass, and a second only for modes."""
    low = check_names(names)
    simple = [AGGREGATES[x](F.col(value)).alias(RESULT_NAMES.get(x, x)) for x in low if x != "mode"] or [F.count(F.lit(1)).alias("_n")]
    out = p.groupBy(*keys).agg(*simple)
    if "mode" in low:
        found = modes(p, *keys, value=value)
        out = out.join(found, list(keys), "left") if keys else out.join(found, F.lit(True), "left")
    return out.select(*keys, *[RESULT_NAMES.get(x, x) for x in low])


@dataclass
class MetricRequest:
    """What to return of one metric."""

    collection: str
    metric: str
    start: int | None = None
    stop: int | None = None
    aggregates: list[str] = field(default_factory=list)
    include_series: bool = True


def answer(p: DataFrame, request: MetricRequest) -> DataFrame:
    """One row: aggregates map<string,double>, modes, series map<long,double>."""
    rows = metric_range(p, request.collection, request.metric, request.start, request.stop).groupBy().agg(
        F.map_from_entries(F.array_compact(F.array(*[F.struct(F.lit(RESULT_NAMES.get(x, x)), AGGREGATES[x](F.col("value")).cast("double")) for x in check_names(request.aggregates) if x != "mode"])))
        .cast("map<string,double>").alias("aggregates")
        if [x for x in check_names(request.aggregates) if x != "mode"]
        else F.create_map().cast("map<string,double>").alias("aggregates"),
        *([F.map_from_entries(F.sort_array(F.collect_list(F.struct("ts", "value")), asc=False)).alias("series")] if request.include_series else []),
    )
    if "mode" in check_names(request.aggregates):
        rows = rows.join(modes(metric_range(p, request.collection, request.metric, request.start, request.stop)), F.lit(True), "left")
    return rows


def resample(p: DataFrame, start: int, end: int = -1, step: int = -1) -> DataFrame:
    """Points from start to end (-1: open), averaged over steps of milliseconds (-1: as they are)."""
    p = p.where(F.col("ts") >= start)
    if end != -1:
        p = p.where(F.col("ts") <= end)
    if step == -1:
        return p.select(*PARTS, "ts", "value")
    at = (F.floor((F.col("ts") - start) / step) * step + start).alias("ts")
    return p.groupBy(*PARTS, at).agg(F.avg("value").alias("value"))


class Analytics:
    """Service verbs over stored points."""

    def __init__(self, p: DataFrame):
        self.points = p

    def supported_metrics(self) -> DataFrame:
        return self.points.select(*PARTS).distinct()

    def metric(self, request: MetricRequest) -> DataFrame:
        return answer(self.points, request)

    def range(self, collection: str, metric: str, start: int | None = None, stop: int | None = None) -> DataFrame:
        return metric_range(self.points, collection, metric, start, stop)
