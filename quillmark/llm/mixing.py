"""Mixing sources to target weights by repetition rates.

Sizes are words. Sources, in code point order with null last, weigh 1, 2, 3,
1, ... and share all words by weight; a target stops at `most` times its
source's size and the excess is shared again by weight until none is above.
That limit is target = min(most * size, level * weight) for the one level at
which targets sum to all words, and the level is found in one ordered pass, over ranges of the
sources, so that there can be millions of them. A
document is emitted floor(rate) times, and once more if a hash of its id, seen
as a number in [0, 1), is below the fraction. Reruns agree.

Nulls and odd input: a null text has no words and a source without words gets
no target and no copies; a null doc_id is replaced by a digest of the text in the draw.
Repeated rows are drawn alike. Columns of the input pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import written

P = "__qm_"
WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"
#: More sources than this are joined by a shuffle with skew handling, not broadcast.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 48 bits, from the document's id alone."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name, the sum of its column over all rows before in the order; parts are ranges of the order, so no task holds all rows.

    What one task gets is one row for each part.
    """
    names = list(sums)
    parts = written(rows.withColumns({"sum_" + k: c for k, c in sums.items()}).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(*[F.sum("sum_" + k).alias("sum_" + k) for k in names])
    starts = starts.select("part", *[F.coalesce(F.sum("sum_" + k).over(whole), F.lit(0)).alias("start_" + k) for k in names])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = [(F.coalesce(F.sum("sum_" + k).over(inside), F.lit(0)) + F.col("start_" + k)).alias(k) for k in names]
    return parts.join(F.broadcast(starts), "part").select(*rows.columns, *own)


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate from one row per source (source, source_size)."""
    by_name = F.col("source").asc_nulls_last()
    rows = before(sizes, [by_name], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(most)))
    # in order of full / weight, the first sources stop at full; the level serves the rest
    rows = before(rows.withColumn("ratio", F.col("full") / F.col("weight")), [F.col("ratio"), by_name], {"stopped": F.col("full"), "served": F.col("weight")})
    totals = rows.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("heavy")).first()
    total, heavy = totals["total"] or 0, totals["heavy"] or 0.0
    # it rises while sources stop below it and falls afterwards, so the greatest is the one that holds
    level = rows.agg(F.max((F.lit(total) - F.col("stopped")) / (F.lit(heavy) - F.col("served")))).first()[0]
    rows = rows.withColumn("level", F.lit(level).cast("double"))
    target = F.when(F.col("source_size") > 0, F.least(F.col("full"), F.col("level") * F.col("weight"))).otherwise(F.lit(0.0))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return rows.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def rates(sized: DataFrame) -> DataFrame:
    """One row per source; the words are summed before the shuffle."""
    return written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "rates")


def _with_rates(rows: DataFrame, source: str, table: DataFrame) -> DataFrame:
    """rows with the columns of their source; broadcast only if the table is small enough."""
    small = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    table = table.select([F.col(c).alias(P + c) for c in table.columns])
    return rows.join(F.broadcast(table) if small else table, F.col(source).eqNullSafe(F.col(P + "source")))


def copies() -> Column:
    """floor(rate), and one more if the draw is below the fraction."""
    whole = F.floor(P + "rate")
    return (whole + F.when(F.col(P + "draw") < F.col(P + "rate") - whole, 1).otherwise(0)).cast("int")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with its source's target and the words that the mix takes of it."""
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias(P + "draw")), "sized")
    out = _with_rates(sized, "source", rates(sized))
    return out.select("doc_id", "size", F.col(P + "source_size").alias("source_size"), F.col(P + "target").alias("target"), (F.col("size") * copies()).alias("taken"), "source", copies().alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns of docs."""
    table = rates(docs.select("source", words(F.col("text")).alias("size")))
    out = _with_rates(docs.withColumn(P + "draw", draw(F.col("doc_id"), F.col("text"))), "source", table)
    return out.withColumn(P + "copy", F.explode(F.array_repeat(F.lit(0), copies()))).select(*docs.columns)
