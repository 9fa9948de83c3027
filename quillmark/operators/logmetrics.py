"""Daily metrics from query and click logs. Every function maps DataFrames to a DataFrame; nothing runs until an action.

A key is a day (timetuple) and a collection. Grouped counts combine before the shuffle; where
a metric needs more than one pass, the passes share the grouping so that the exchange is reused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import log_tokens

KEY = ["timetuple", "collection"]


def has_hits(logs: DataFrame) -> DataFrame:
    return logs.where("hits IS NOT NULL AND hits > 0")


def fewer_hits(logs: DataFrame, n: int) -> DataFrame:
    return logs.where(F.col("hits").isNull() | (F.col("hits") < n))


def distinct_queries(logs: DataFrame) -> DataFrame:
    """Distinct queries with hits."""
    return has_hits(logs).groupBy(*KEY).agg(F.countDistinct("query").alias("value"))


def total_queries(logs: DataFrame) -> DataFrame:
    return has_hits(logs).groupBy(*KEY).agg(F.count("query").alias("value"))


def low_result_queries(logs: DataFrame, n: int = 100) -> DataFrame:
    """Queries without hits or with fewer than n; the metric is named lt-<n>-results."""
    return fewer_hits(logs, n).groupBy(*KEY).agg(F.count("query").alias("value")).withColumn("metric", F.lit(f"lt-{n}-results"))


def most_hits(logs: DataFrame) -> DataFrame:
    """Greatest hits of each distinct query."""
    return has_hits(logs).groupBy(*KEY, "query").agg(F.max("hits").alias("hits"))


def bins_of(count: Column) -> Column:
    return F.ceil(F.log(count) + 1).cast("int")


def histogram(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """least, greatest, n_bins and bins[] of a whole-number column in each group.

    n_bins = ceil(ln(count) + 1), width = ceil((max - min + 1) / n_bins), bin = floor((v - min) / width).
    """
    stats = rows.groupBy(*keys).agg(F.min(value).cast("long").alias("least"), F.max(value).cast("long").alias("greatest"), F.count(F.lit(1)).alias("n"))
    stats = stats.withColumn("n_bins", bins_of(F.col("n"))).withColumn("width", F.expr("(greatest - least + 1 + n_bins - 1) div n_bins"))
    counts = rows.groupBy(*keys, F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    binned = counts.join(stats, list(keys)).withColumn("bin", F.expr("(v - least) div width").cast("int"))
    sums = binned.groupBy(*keys, "least", "greatest", "n_bins", "bin").agg(F.sum("c").alias("c"))
    sums = sums.groupBy(*keys, "least", "greatest", "n_bins").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("filled"))
    zero_filled = F.transform(F.sequence(F.lit(0), F.col("n_bins") - 1), lambda i: F.coalesce(F.try_element_at("filled", i), F.lit(0)))
    return sums.select(*keys, "least", "greatest", "n_bins", zero_filled.alias("bins"))


def result_histogram(logs: DataFrame) -> DataFrame:
    return histogram(most_hits(logs), "hits", *KEY)


def first_clicks(clicks: DataFrame) -> DataFrame:
    """Reciprocal rank of the first click of each (collection, day, id); ties go to the lower position. Combined before the shuffle."""
    first = F.min(F.struct("timestamp", "position"))["position"]
    return clicks.groupBy(*KEY, "id").agg((F.lit(1.0) / (first + 1)).alias("rr"))


def reciprocal_ranks(queries: DataFrame, clicks: DataFrame) -> DataFrame:
    """Query rows joined to the first click of their id; ids without a match go."""
    return queries.join(first_clicks(clicks), [*KEY, "id"])


def mean_reciprocal_rank(queries: DataFrame, clicks: DataFrame) -> DataFrame:
    return reciprocal_ranks(queries, clicks).groupBy(*KEY).agg(F.avg("rr").alias("value"))


def _top(counts: DataFrame, name: str, n: int) -> DataFrame:
    """The n most frequent of each key with the key's total; ties by name."""
    order = Window.partitionBy(*KEY).orderBy(F.col("count").desc(), F.col(name))
    # totals are a sum of their own, so that each task keeps only its n best before the shuffle
    totals = counts.groupBy(*KEY).agg(F.sum("count").alias("total"))
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return best.join(totals, KEY)


def query_counts(logs: DataFrame) -> DataFrame:
    return has_hits(logs).groupBy(*KEY, "query").agg(F.count(F.lit(1)).alias("count"))


def popular_queries(logs: DataFrame, n: int = 10) -> DataFrame:
    return _top(query_counts(logs), "query", n)


def popular_terms(logs: DataFrame, n: int = 10, reference_mode: bool = False) -> DataFrame:
    """Most frequent terms of queries. In reference_mode counts of a term are not summed over queries, so it can appear again."""
    terms = query_counts(logs).withColumn("term", F.explode(log_tokens(F.col("query"))))
    if not reference_mode:
        terms = terms.groupBy(*KEY, "term").agg(F.sum("count").alias("count"))
    return _top(terms, "term", n)
