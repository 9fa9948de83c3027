import pytest
from pyspark.sql import functions as F

from quillmark.functions import html, scalars, text
from quillmark.operators import clicks, documents, logmetrics, metrics
from quillmark.plans import predicate, search


def test_histogram(spark):
    df = spark.createDataFrame([("a", h) for h in (1, 2, 3, 10)], "k string, hits int")
    r = logmetrics.histogram(df, "hits", "k").first()
    assert (r.least, r.greatest, r.n_bins, r.bins) == (1, 10, 3, [3, 0, 1])


def test_metric_aggregates(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 4.0, 4.0)] + [("b", 7.0)], "k string, value double")
    rows = {r.k: r for r in metrics.aggregate(df, ["sum", "COUNT", "mean", "median", "mode", "var"], "k").collect()}
    a, b = rows["a"], rows["b"]
    assert (a["sum"], a["cnt"], a["mean"], a["median"], a["mode"], round(a["var"], 9)) == (13, 5, 2.6, 2, [2, 4], 1.8)
    assert (b["median"], b["var"]) == (7, 0)
    with pytest.raises(ValueError):
        metrics.check_names(["nope"])


def test_decay_and_document_filter(spark):
    assert spark.range(1).select(scalars.decay(F.lit(8.0), F.lit(60 * 86_400_000))).first()[0] == 2
    df = spark.createDataFrame([("u", {"lang": "en", "tc": "true"}), ("u", {"lang": "fr"}), (None, {})], "url string, metadata map<string,string>")
    assert documents.DocumentFilter(keep={"lang": "en"}).apply(df).count() == 1
    assert documents.DocumentFilter(skip={"lang": ".+"}).apply(df).count() == 1
    assert documents.DocumentFilter(url=".+").apply(df).count() == 2 and not documents.DocumentFilter().required()
    with pytest.raises(ValueError):
        documents.DocumentFilter(keep={"a": "b"}, skip={"a": "b"})


def test_predicates(spark):
    df = spark.createDataFrame([(1, "x", None), (None, "y", 2.0), (3, None, 5.0)], "a int, b string, c double")
    count = lambda q: df.where(predicate.predicate(q, df.schema)).count()
    assert [count("a=1"), count("a!=1"), count("!a=1"), count("b.in(x,y)&c>1"), count("a=null"), count("_x=1")] == [1, 2, 2, 1, 1, 3]
    for bad in ("(a=1", "a.in()", "zz=1", "a=1&"):
        with pytest.raises(predicate.InvalidQuery):
            df.where(predicate.predicate(bad, df.schema))


def test_search_and_html(spark):
    df = search.indexed(spark.createDataFrame([(1, "the quick brown fox"), (2, "quick the"), (3, None)], "id int, text string"), "text")
    ids = lambda q: sorted(r.id for r in search.matches(df, q).collect())
    assert ids('"quick brown"') == [1] and ids("the -fox") == [2] and ids("") == [1, 2, 3] and ids("fax~1") == [1] and ids("quick BEFORE:1 fox") == [1] and ids("bro* ?ox") == [1]
    assert search.minimum_match("50%", 3) == 1 and search.minimum_match("2", 3) == 2
    assert html.parse("<HTML><TITLE>A TITLE</TITLE><BODY>This is a <B>simple</B> test</HTML>")[0] == "A TITLE\nThis is a simple test"
    assert spark.range(1).select(text.PLURALS.column(F.lit("ponies"))).first()[0] == "pony"


def test_collapse():
    assert clicks.collapse([("a b", 1.0, 0.0), ("a b c", 2.0, 0.0), ("x y", 1.0, 0.0)]) == [("a b c", 3.0, 0.0), ("x y", 1.0, 0.0)]


def test_add_to_map_under_the_default_policy(spark):
    name = "spark.sql.mapKeyDedupPolicy"
    kept = spark.conf.get(name)
    spark.conf.set(name, "EXCEPTION")
    try:
        df = spark.createDataFrame([({"a": "1", "b": "2"}, "a"), (None, "b"), ({"c": None}, "b")], "m map<string,string>, k string")
        put = scalars.add_to_map(F.col("m"), F.col("k"), F.lit("x"), F.lit("b"), F.lit("y"))
        assert [r[0] for r in df.select(put).collect()] == [{"a": "x", "b": "y"}, {"b": "y"}, {"c": None, "b": "y"}]
    finally:
        spark.conf.set(name, kept)


def test_slop_at_the_start_of_a_text(spark):
    texts = ["of a b c the", "of a b the", "the of", "x the a of", "of a b", "x x of a b the", "x x of a b c the", "the x of", "the x x of", "of a b c the of the"]
    df = search.indexed(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text")
    ids = lambda q: sorted(r.id for r in search.matches(df, q).collect())
    assert ids('"of the"~2') == [1, 2, 5, 9] and ids('"of the"~3') == [0, 1, 2, 3, 5, 6, 7, 9] and ids('"of * the"~1') == [1, 5, 9]
