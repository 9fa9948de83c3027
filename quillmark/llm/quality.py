"""Quality rules with risk-controlled thresholds, in DataFrame and SQL operations only.

Each rule is a ratio that junk has more of. A document fails a rule if its
ratio exceeds the cutoff of its stratum. Cutoffs come from labelled good
documents: for each stratum and rule, a fixed grid is walked from the loosest
cutoff to the strictest, and a cutoff is certified while the exact binomial
test rejects "this cutoff wrongly rejects more than `risk` of the good
documents". Walking in a fixed order needs no correction along the grid; over
strata and rules the level is divided by their number (Bonferroni). The last
certified cutoff is used, and where none is certified the rule rejects nothing.
So with probability 1 - `delta` no rule wrongly rejects more than `risk` of the
good documents of any stratum.

A stratum with too few good labels to certify any cutoff, even without a wrong
rejection, is not tested by itself, so its share of the level is free. All such strata
are tested as one pool, at the share of one of them. A cutoff certified for the
pool is used in those of its strata that have labels and whose own labels show no more than
`risk` wrongly rejected. For them the bound holds over the pool, not for each one.

Grid and ratios are fixed beforehand, so every labelled row is a holdout row.
Strata are the named languages and one for all others and null, so the table
of cutoffs has a fixed size and needs no join.

Nulls and odd input: a null text counts as empty. Empty texts have zero for
every count and fail the base rules. Labels without doc_id or quality are
left out, of several labels of a document the lowest counts. Repeated rows
are judged alike, each for itself; without labels nothing beyond the base rules
is rejected. Extra columns are passed through by `judge`, and may have the names of counts. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.session import written

SPACE = r"[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LANGUAGES = ("de", "en", "es", "fr")
MIN_WORDS = 50
#: Share of good documents that one rule may wrongly reject in a stratum, and the chance that any rule does.
RISK, DELTA = 0.01, 0.05
#: Rule: numerator column, and cutoffs of its ratio to n_words from the loosest to the strictest.
RULES = {
    "symbols": ("n_symbols", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "shouts": ("n_exclaims", (1.5, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "repeats": ("n_repeat_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "lines": ("n_dup_lines", (0.2, 0.1, 0.05, 0.03, 0.02, 0.01)),
    "length": ("word_chars", (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
}
P = "__qm_"


def _without(text: Column, chars: str) -> Column:
    """text without some characters, by one pass over its bytes for each; translate would look every character up."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(_without(text, chars))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """docs and the counts, in columns named with P in front; one pass over whole texts, nothing shuffled."""
    t = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(P + "text", t).withColumn(P + "words", F.expr(f"filter(split({P}text, '{SPACE}'), x -> x != '')"))
    out = out.withColumn(P + "n_words", F.size(P + "words").cast("long"))
    # hash and place of every 3-word window, sorted by hash; words is named several times so that it is computed once
    out = out.withColumn(
        P + "grams",
        F.expr(
            f"if({P}n_words >= 3, sort_array(transform(sequence(1, size({P}words) - 2), "
            f"i -> struct(xxhash64({P}words[i - 1], {P}words[i], {P}words[i + 1]) AS h, i AS i))), array())"
        ),
    )
    out = out.withColumn(
        P + "places",
        F.expr(
            f"sort_array(filter(transform({P}grams, (g, k) -> if((k > 0 AND {P}grams[greatest(k - 1, 0)].h = g.h) OR "
            f"(k < size({P}grams) - 1 AND {P}grams[least(k + 1, size({P}grams) - 1)].h = g.h), g.i, NULL)), x -> x IS NOT NULL))"
        ),
    )
    lines = F.filter(F.split(F.col(P + "text"), "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    return (
        out.withColumn(P + "lines", lines)
        .withColumn(P + "word_chars", F.length(_without(F.col(P + "text"), SPACES)).cast("long"))
        .withColumn(P + "n_symbols", _count_chars(F.col(P + "text"), SYMBOLS))
        .withColumn(P + "n_exclaims", _count_chars(F.col(P + "text"), "!"))
        .withColumn(P + "n_dup_lines", (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long"))
        .withColumn(
            P + "n_repeat_words",
            F.expr(f"aggregate({P}places, struct(0L AS e, 0L AS n), (a, p) -> struct(p + 3L AS e, a.n + 3L - greatest(0L, a.e - p) AS n), a -> a.n)"),
        )
        .withColumn(P + "stratum", F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(F.lit("")))
        .drop(P + "text", P + "words", P + "grams", P + "places", P + "lines")
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims")


def ratio(rule: str) -> Column:
    return F.col(P + RULES[rule][0]) / F.greatest(F.col(P + "n_words"), F.lit(1))


def base_failed() -> Column:
    return (F.col(P + "n_words") < MIN_WORDS) | (100 * F.col(P + "n_repeat_words") > 50 * F.col(P + "n_words"))


def binomial_cdf(k: str, n: str, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly term by term in logarithms."""
    step = f"a.t + ln((CAST({n} AS DOUBLE) - i + 1) / i) + ln({p}D / (1 - {p}D))"
    return F.expr(
        f"exp(aggregate(if({k} > 0, sequence(1L, CAST({k} AS BIGINT)), array()), "
        f"struct({n} * ln(1 - {p}D) AS t, {n} * ln(1 - {p}D) AS s), "
        f"(a, i) -> struct({step} AS t, greatest(a.s, {step}) + log1p(exp(-abs(a.s - ({step})))) AS s), a -> a.s))"
    )


def certified_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """{(stratum, rule): cutoff} of what is certified, from all labelled good documents that pass the base rules.

    Only the finished table, at most one row for each stratum and rule, comes to the driver.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    rows = counted.where(~base_failed()).join(good, "doc_id").select(P + "stratum", *[ratio(r).alias(r) for r in RULES])
    sums = rows.groupBy(P + "stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, (_, grid) in RULES.items() for i, c in enumerate(grid)]
    )
    level = delta / ((len(LANGUAGES) + 1) * len(RULES))
    names = [c for c in sums.columns if c not in (P + "stratum", "n")]
    small = F.exp(F.col("n") * math.log(1 - risk)) > level
    pool = sums.where(small).agg(*[F.sum(c).alias("pool_" + c) for c in ("n", *names)])
    sums = sums.crossJoin(F.broadcast(pool)).select(
        P + "stratum",
        F.when(small, F.col("pool_n")).otherwise(F.col("n")).alias("n"),
        *[F.when(small, F.col("pool_" + c)).otherwise(F.col(c)).alias(c) for c in names],
        *[(~small | (F.col(c) <= risk * F.col("n"))).alias("fair_" + c) for c in names],
    )
    tests = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k"), F.col(f"fair_{r}_{i}").alias("fair"))
            for r, (_, grid) in RULES.items()
            for i, c in enumerate(grid)
        ]
    )
    tested = sums.select(P + "stratum", "n", F.explode(tests).alias("x")).select(P + "stratum", "n", "x.*").withColumn("passed", F.col("fair") & (binomial_cdf("k", "n", risk) <= level))
    failed = F.min(F.when(~F.col("passed"), F.col("i")))
    found = (
        tested.groupBy(P + "stratum", "rule")
        .agg(failed.alias("stop"), F.sort_array(F.collect_list(F.struct("i", "cutoff"))).alias("grid"))
        .select(P + "stratum", "rule", F.expr("try_element_at(grid, coalesce(stop, size(grid))).cutoff").alias("cutoff"), "stop")
        .where("stop IS NULL OR stop > 0")
    )
    return {(r[0], r[1]): r[2] for r in found.collect()}


def verdict(cutoffs: dict[tuple[str, str], float]) -> Column:
    """True for documents that pass the base rules and every certified cutoff of their stratum."""
    fails = base_failed()
    for (stratum, rule), cutoff in sorted(cutoffs.items()):
        fails = fails | ((F.col(P + "stratum") == stratum) & (ratio(rule) > F.lit(cutoff)))
    return ~fails


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and counts of every document, written once."""
    return written(features(docs.select("doc_id", "text", "lang")).select("doc_id", P + "stratum", *[P + c for c in COUNTS]), "quality")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    counted = measured(docs)
    cutoffs = certified_cutoffs(counted, labels)
    return counted.select("doc_id", *[F.col(P + c).alias(c) for c in COUNTS[:5]], base_failed().alias("base_failed"), verdict(cutoffs).alias("kept"), F.col(P + "n_exclaims").alias("n_exclaims"), F.col(P + "stratum").alias("stratum"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents, with all their columns."""
    # written once: the counts serve the cutoffs and the verdict, and no filter is pushed into their expressions
    counted = written(features(docs), "quality")
    return counted.where(verdict(certified_cutoffs(counted, labels))).select(*docs.columns)
