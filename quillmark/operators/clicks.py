"""Click-through relevance: weights of query shingles for clicked documents, sums, decayed boosts.

Sums are partial aggregates. Only the order-dependent collapse of contained phrases runs in
pandas, one document's terms at a time, after they are cut to those that can matter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.scalars import HALF_LIFE_MS, HISTORY, current_boost, decay, position_weight, reading_weight
from quillmark.functions.text import shingles, words

TOP_TERMS, MAX_TERMS, MIN_WEIGHT = 20, 100, 1.0
TERM = "struct<term:string,pos:double,time:double>"


def dwell_times(clicks: DataFrame) -> DataFrame:
    """clicks with dwell: time to the next click of the request; the last gets the mean of the others."""
    order = Window.partitionBy("request_id").orderBy("time", "position", "doc")
    own = F.lead("time").over(order) - F.col("time")
    rows = clicks.withColumn("dwell", own)
    mean = F.avg("dwell").over(Window.partitionBy("request_id"))
    return rows.withColumn("dwell", F.coalesce(F.col("dwell").cast("double"), mean, F.lit(0.0)))


def prepare(queries: DataFrame, clicks: DataFrame, largest: int = 2, reference_mode: bool = False) -> DataFrame:
    """doc, term, pos, time: a row for each click and shingle of its query, and one of weight 0.5 for document * per query.

    Clicks without a query of their request are left out. In reference_mode reading time has no weight.
    """
    q = queries.select("request_id", F.explode(shingles(words(F.col("query")), largest)).alias("term"))
    c = clicks if reference_mode else dwell_times(clicks)
    time = F.lit(0.0) if reference_mode else reading_weight(F.col("dwell"))
    hits = c.join(q, "request_id").select("doc", "term", position_weight(F.col("position")).alias("pos"), time.alias("time"))
    return hits.unionByName(q.select(F.lit("*").alias("doc"), "term", F.lit(0.5).alias("pos"), F.lit(0.0).alias("time")))


def term_weights(prepared: DataFrame, least: float = MIN_WEIGHT) -> DataFrame:
    """Sum of position weights of each term, if it is at least `least`."""
    return prepared.groupBy("term").agg(F.sum("pos").alias("pos")).where(F.col("pos") >= least)


def doc_term_weights(prepared: DataFrame) -> DataFrame:
    return prepared.where("doc != '*'").groupBy("doc", "term").agg(F.sum("pos").alias("pos"), F.sum("time").alias("time"))


def collapse(terms: list[tuple[str, float, float]], top: int = TOP_TERMS) -> list[tuple[str, float, float]]:
    """The queue of a document's heaviest phrases, fed in order of term.

    A phrase inside another (at word borders) adds its weight to that; one that contains another absorbs it. A full
    queue takes a new phrase for its lightest, unless the new one is lighter.
    """
    held: dict[str, list[float]] = {}
    for term, pos, time in sorted(terms):
        inside = f" {term} "
        for key in sorted(held):
            if inside in f" {key} ":
                held[key][0] += pos
                held[key][1] += time
                break
            if f" {key} " in inside:
                a, b = held.pop(key)
                held[term] = [pos + a, time + b]
                break
        else:
            if len(held) >= top:
                low = min(held, key=lambda k: (held[k][0] + held[k][1], k))
                if pos + time < sum(held[low]):
                    continue
                del held[low]
            held[term] = [pos, time]
    return sorted(((k, a, b) for k, (a, b) in held.items()), key=lambda x: (-x[1], x[0]))


def aggregate_docs(prepared: DataFrame, top: int = TOP_TERMS, collapsed: bool = True) -> DataFrame:
    """doc and its top terms (array of term, pos, time)."""
    sums = doc_term_weights(prepared)
    if not collapsed:
        order = Window.partitionBy("doc").orderBy(F.col("pos").desc(), "term")
        best = sums.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)
        return best.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("_n", "term", "pos", "time"))).alias("t")).select("doc", F.transform("t", lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos"), x["time"].alias("time"))).alias("terms"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        found = collapse(list(pdf[["term", "pos", "time"]].itertuples(index=False, name=None)), top)
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "terms": [[{"term": t, "pos": p, "time": s} for t, p, s in found]]})

    return sums.groupBy("doc").applyInPandas(group, f"doc string, terms array<{TERM}>")


BOOST = f"doc string, pos_boost double, time_boost double, terms array<{TERM}>, pos_log array<double>, time_log array<double>, times array<long>"


def current_boosts(aggregated: DataFrame) -> DataFrame:
    """Boost records without history."""
    none, no_times = F.array().cast("array<double>"), F.array().cast("array<long>")
    return aggregated.select("doc", current_boost(F.transform("terms", lambda t: t["pos"])).alias("pos_boost"), F.lit(0.0).alias("time_boost"), "terms", none.alias("pos_log"), none.alias("time_log"), no_times.alias("times"))


def _history(log: str, now: Column, at: Column, history: int, half_life: int, smooth: bool) -> tuple[Column, Column]:
    """(shifted log with the current value first, current value plus decayed history)."""
    zeros = F.array_repeat(F.lit(0.0), history)
    padded = F.slice(F.concat(F.coalesce(F.col(log), F.array().cast("array<double>")), zeros), 1, history)
    times = F.slice(F.concat(F.coalesce(F.col("times"), F.array().cast("array<long>")), F.array_repeat(F.lit(0).cast("long"), history)), 1, history)
    last, last_time = padded[history - 1], times[history - 1]
    age = times[history - 2] - last_time
    share = age / F.lit(half_life)
    folded = decay(last, age, half_life, smooth)
    folded = F.when((share < 1) & (folded > last * (1 - share)), last * (1 - share)).otherwise(folded)
    merged = F.transform(padded, lambda v, i: v + F.when((i == history - 2) & (last_time > 0), folded).otherwise(0.0))
    shifted = F.concat(F.array(now), F.slice(merged, 1, history - 1))
    new_times = F.concat(F.array(at), F.slice(times, 1, history - 1))
    decayed = F.zip_with(F.slice(shifted, 2, history), F.slice(new_times, 2, history), lambda v, t: decay(v, at - t, half_life, smooth))
    return shifted, now + F.aggregate(decayed, F.lit(0.0), lambda a, x: a + x)


def merge_boosts(records: DataFrame, update_time: int, history: int = HISTORY, half_life: int = HALF_LIFE_MS, max_terms: int = MAX_TERMS, smooth: bool = False) -> DataFrame:
    """Boost records per document, from current ones (no history) and at most one previous (with history).

    Current boosts and term weights are summed, the heaviest max_terms terms stay; history is shifted, its oldest
    slot folded into the next, and decayed values are added. Without current records the previous terms stay.
    """
    previous = records.where(F.size("pos_log") > 0).groupBy("doc").agg(F.max_by(F.struct("terms", "pos_log", "time_log", "times"), F.try_element_at("times", F.lit(1))).alias("p")).select("doc", F.col("p.terms").alias("old_terms"), "p.pos_log", "p.time_log", "p.times")
    fresh = records.where(F.size("pos_log") == 0)
    sums = fresh.groupBy("doc").agg(F.sum("pos_boost").alias("pos_boost"), F.sum("time_boost").alias("time_boost"))
    terms = fresh.select("doc", F.explode("terms").alias("t")).groupBy("doc", "t.term").agg(F.sum("t.pos").alias("pos"), F.sum("t.time").alias("time"))
    order = Window.partitionBy("doc").orderBy(F.col("pos").desc(), "term")
    best = terms.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_terms)
    best = best.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("_n", "term", "pos", "time"))).alias("t")).select("doc", F.transform("t", lambda x: F.struct(x["term"].alias("term"), x["pos"].alias("pos"), x["time"].alias("time"))).alias("new_terms"))
    rows = sums.join(best, "doc", "left").join(previous, "doc", "full_outer")
    at = F.lit(update_time).cast("long")
    now_pos, now_time = F.coalesce("pos_boost", F.lit(0.0)), F.coalesce("time_boost", F.lit(0.0))
    pos_log, pos = _history("pos_log", now_pos, at, history, half_life, smooth)
    time_log, time = _history("time_log", now_time, at, history, half_life, smooth)
    times = F.slice(F.concat(F.array(at), F.coalesce("times", F.array().cast("array<long>")), F.array_repeat(F.lit(0).cast("long"), history)), 1, history)
    kept = F.coalesce("new_terms", F.when(F.col("pos_boost").isNull(), F.col("old_terms")), F.array().cast(f"array<{TERM}>"))
    return rows.select("doc", pos.alias("pos_boost"), time.alias("time_boost"), kept.alias("terms"), pos_log.alias("pos_log"), time_log.alias("time_log"), times.alias("times"))


def record_text(boosts: DataFrame) -> DataFrame:
    """doc and its record line: pos, time, term:pos:time list, histories and times, tab-delimited."""
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["pos"].cast("string"), t["time"].cast("string"))), ",")

    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")

    return boosts.select("doc", F.concat_ws("\t", F.col("pos_boost").cast("string"), F.col("time_boost").cast("string"), terms, joined("pos_log"), joined("time_log"), joined("times")).alias("record"))


def parse_records(lines: DataFrame) -> DataFrame:
    """Boost records from doc, record; blank lines and those that start with # go."""
    f = F.split("record", "\t")

    def numbers(i: int, kind: str) -> Column:
        return F.transform(F.filter(F.split(F.get(f, i), ","), lambda x: x != ""), lambda x: x.cast(kind))

    def term(x: Column) -> Column:
        p = F.split(x, ":")
        return F.struct(F.array_join(F.slice(p, 1, F.size(p) - 2), ":").alias("term"), F.element_at(p, -2).cast("double").alias("pos"), F.element_at(p, -1).cast("double").alias("time"))

    rows = lines.where((F.trim("record") != "") & ~F.startswith(F.col("record"), F.lit("#")))
    return rows.select("doc", f[0].cast("double").alias("pos_boost"), f[1].cast("double").alias("time_boost"), F.transform(F.filter(F.split(F.get(f, 2), ","), lambda x: x != ""), term).alias("terms"), numbers(3, "double").alias("pos_log"), numbers(4, "double").alias("time_log"), numbers(5, "long").alias("times"))


def join_boosts(docs: DataFrame, boosts: DataFrame, key: str = "id", name: str = "click") -> DataFrame:
    """docs with <name>_terms, <name>_val and <name> = 1 where a boost is known."""
    b = boosts.select(F.col("doc").alias(key), F.transform("terms", lambda t: t["term"]).alias(f"{name}_terms"), F.col("pos_boost").alias(f"{name}_val"), F.lit(1).alias(name))
    return docs.join(b, key, "left")


def sessions(queries: DataFrame, clicks: DataFrame) -> DataFrame:
    """One row per request: its query and its clicks in order of time; requests without query are left out."""
    c = clicks.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("time", "doc", "position"))).alias("clicks"))
    return queries.join(c, "request_id", "left").withColumn("clicks", F.coalesce("clicks", F.array().cast("array<struct<time:bigint,doc:string,position:int>>")))
