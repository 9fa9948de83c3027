"""Workflow, registry, streams, parser limits and small functions."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillmark.functions import scalars, text
from quillmark.operators import clicks, documents, logmetrics, metrics, resources, textmining
from quillmark.plans import predicate, search
from quillmark.plans.workflow import Workflow
from quillmark.sources import logs
from quillmark.streaming import logs as streams


def test_workflow_of_all_steps(spark):
    stored = spark.createDataFrame([], documents.DOCUMENT)
    rows = [(str(i), "c", 0, None, None, f"<p>alpha beta gamma {'delta' if i % 2 else 'omega'} {i}</p>".encode()) for i in range(8)]
    batch = spark.createDataFrame(rows, "id string, collection string, version long, contentType string, text string, content binary")
    batch = batch.select(*[F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes])
    flow = Workflow(annotate=True, kmeans=True, sips=True, simdoc=True, clusters=2)
    assert flow.steps() == ["ingest", "extract", "vectorize", "annotate", "kmeans", "simdoc", "sips", "index_sips"] and Workflow().steps() == ["ingest", "extract"]
    out = flow.run(stored, batch)
    docs = {r.id: r for r in out["documents"].collect()}
    assert docs["1"].text == "alpha beta gamma delta 1" and docs["1"].version == 1 and len(docs["1"].annotations) == 5
    assert {r.phrase for r in out["sips"].collect()} <= {"alpha beta", "beta gamma", "gamma delta", "gamma omega"} and out["kmeans"].count() == 8
    assert {x.id for x in out["simdoc"].where("doc = '1'").first().similar} >= {"3", "5", "7"}
    with pytest.raises(ValueError):
        Workflow().run(stored, batch.limit(0))


def test_model_registry(spark, tmp_path):
    r = textmining.ModelRegistry(spark, str(tmp_path / "models"))
    assert r.models().count() == 0 and r.get("a") is None
    assert r.put("a", location="hdfs:/m/a", type="nb", categories=3) == 1 and r.put("b", location="s3:/b") == 1
    assert r.put("a", 1, provider="x") == 2 and (r.get("a").location, r.get("a").provider, r.get("a").version) == ("hdfs:/m/a", "x", 2)
    for stale in (0, 1, 5):
        with pytest.raises(textmining.VersionConflict):
            r.put("a", stale)
    assert [x.name for x in r.grep("^hdfs:").collect()] == ["a"] and [x.name for x in r.grep("^b$", "name").collect()] == ["b"]
    r.delete("a")
    assert [x.name for x in r.models().collect()] == ["b"]


def test_annotators_and_labels(spark):
    docs = spark.createDataFrame([("1", "Ann Lee met Ann in Rome", {"topic": "x"}), ("2", None, {})], "id string, text string, metadata map<string,string>")
    found = {r.id: [(a.type, a.start, a.end, a.features["string"]) for a in r.annotations] for r in textmining.annotated(docs, textmining.gazetteer({"Person": ["Ann", "Ann Lee"], "Location": ["Rome"]})).collect()}
    assert found == {"1": [("Person", 0, 7, "Ann Lee"), ("Person", 12, 15, "Ann"), ("Location", 19, 23, "Rome")], "2": []}
    assert [(r.id, r.label) for r in textmining.labels(docs, "metadata", "topic").collect()] == [("1", "x")]
    tokens = textmining.annotation_tokens(textmining.annotated(docs, textmining.token_annotator))
    assert tokens.where("id = '1'").first().tokens == ["Ann", "Lee", "met", "Ann", "in", "Rome"]


def test_vector_options(spark):
    tf = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "a", 1), (3, "a", 1), (3, "c", 2)], "doc_id long, term string, tf long")
    got = {(r.doc_id, r.term): r.weight for r in textmining.tfidf(tf, 3, min_support=1, max_df_percent=100, weight="tf", norm="inf").collect()}
    assert got[1, "a"] == 0.75 and got[1, "b"] == 1
    assert {r.term for r in textmining.tfidf(tf, 3, min_support=1, max_df_percent=100, max_df_sigma=1.0).collect()} == {"b", "c"}
    docs = spark.createDataFrame([(i, ["new", "york", f"w{i}", f"v{i}"]) for i in range(20)], "doc_id long, tokens array<string>")
    pairs = {r.term for r in textmining.term_frequencies(docs, n=2, min_llr=20.0).collect() if " " in r.term}
    assert pairs == {"new york"} and len({r.term for r in textmining.term_frequencies(docs, n=2).collect()}) > 60
    vectors = textmining.vectorised(spark.createDataFrame([(1, "the cat sat"), (2, "a dog sat"), (3, None)], "id long, text string"), n=2, max_df=1.0)
    sizes = {r.id: r.features.numNonzeros() for r in vectors.collect()}
    assert sizes[1] == 3 and sizes[3] == 0


def test_row_ids_and_modes(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "doc_id long").repartition(5)
    assert [tuple(r) for r in textmining.row_ids(df).orderBy("row").collect()] == [(i, i) for i in range(101)]
    p = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 3.0, 3.0, None)], "value double")
    assert metrics.modes(p).first().mode == [2.0, 3.0] and metrics.aggregate(p, ["mode", "COUNT"]).first().asDict() == {"mode": [2.0, 3.0], "cnt": 5}


def test_parser_limits_and_functions(spark):
    df = search.indexed(spark.createDataFrame([(1, "alpha beta", 2.0), (2, "beta", 5.0)], "id int, text string, rank double"), "text")
    for bad, options in (("x" * (search.MAX_QUERY + 1), {}), ("a " * (search.MAX_TERMS + 1), {}), ("alpha beta gamma", {"max_clauses": 2}), ("_val_:nothing", {}), ("nofield:x", {})):
        with pytest.raises(search.SearchError):
            search.matches(df, bad, search.Options(**options))
    found = {r.id: r.score for r in search.search(df, "_val_:rank^3", search.Options(relevance=False)).collect()}
    assert found == {1: 6.0, 2: 15.0}
    assert {r.id: r.score for r in search.search(df, "_val_:f", search.Options(relevance=False, functions={"f": F.col("rank") + 1})).collect()} == {1: 3.0, 2: 6.0}
    ids = lambda q, **o: sorted(r.id for r in search.matches(df, q, search.Options(**o)).collect())
    assert ids("ALL:alpha") == [1] and ids("*:*") == [1, 2] and ids("DEFAULT:alpha") == [1] and ids("alpha AFTER:0 beta") == [] and ids("beta AFTER:0 alpha") == [1]
    near, far = (search.search(df, "alpha beta", search.Options(relevance=r)).first().score for r in (True, False))
    assert near > far  # adjacent terms that stand together score more
    assert search.landing_page("  Big  Sale ", {"big sale": "/sale"}) == "/sale" and search.landing_page("x", {}) is None
    norm = spark.range(1).select(search.length_norm(F.lit(1)), search.scaled_length_norm(F.lit(1), 2.0)).first()
    assert (norm[0], norm[1]) == (1.0, 2.0)
    got = spark.range(1).select(search.boost_recent(F.lit(4.0), F.lit(3.0))).first()[0]
    assert got == 1.0
    marks = search.highlighted(df, "beta", mode="OFFSETS").select("id", "offsets").orderBy("id").collect()
    assert [[(o.start, o.end) for o in r.offsets] for r in marks] == [[(6, 10)], [(0, 4)]]


def test_feedback_finds_related_rows(spark):
    rows = [(i, "query common topic topic theme theme" if i < 6 else "topic theme topic theme" if i < 9 else "other words other words") for i in range(14)]
    df = search.indexed(spark.createDataFrame(rows, "id int, text string"), "text")
    plain = {r.id for r in search.search(df, "query", search.Options(relevance=False)).collect()}
    wide = {r.id for r in search.with_feedback(df, "query", "id", search.Options(relevance=False), min_tf=2, min_df=2, mode="recall").collect()}
    assert plain == set(range(6)) and wide == set(range(9))
    assert {r.id for r in search.with_feedback(df, "query", "id", search.Options(relevance=False), min_tf=2, min_df=2).collect()} == plain


def test_predicates_more(spark):
    df = spark.createDataFrame([(1, {10: 1.0, 20: 3.0, 40: 5.0}), (2, {})], "id int, series map<bigint,double>")
    whole = predicate.query(df, "fields=id,series[15]").orderBy("id").collect()
    assert [r.series for r in whole] == [{20: 3.0, 40: 5.0}, {}]
    steps = predicate.query(df, "fields=id,series[0,30,25]").orderBy("id").first()
    assert steps.series == {0: 2.0}
    with pytest.raises(predicate.InvalidQuery):
        predicate.query(df, "fields=id[1,2,3]")
    assert predicate.query(df, "fields=*").count() == 2 and predicate.query(df, "", keys={"id": 2}).count() == 1
    with pytest.raises(ValueError):
        metrics.check_names(["sum", "nope"])


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(scalars.mime_clean(F.lit("Text/HTML; charset=x"))).first()[0] == "Text/HTML" and one.select(scalars.mime_clean(F.lit(None).cast("string"))).first()[0] is None
    ids = spark.range(50).select(scalars.new_id().alias("u"), scalars.hash_id(F.col("id").cast("string"), F.lit("x")).alias("h")).collect()
    assert len({r.u for r in ids}) == 50 and len({r.h for r in ids}) == 50 and all(len(r.h) == 40 for r in ids)
    s = text.Synonyms("usa, united states => america\ncar, auto # same\n")
    assert s.lookup("the united states auto".split()) == [[("the",)], [("america",)], [("car",), ("auto",)]]
    stems = text.StemRules("*ss\n*??ies -> y\nmen -> man\n*?s -> *")
    assert [one.select(stems.column(F.lit(w))).first()[0] for w in ("glass", "ponies", "men", "cats", "s")] == ["glass", "pony", "man", "cat", "s"]
    flat, info = resources.flat_body(json.dumps([{"RequestInfo": {"query": "a=1"}, "Cluster": {"name": "x", "tags": ["b", "a", "b"], "in": {"n": 1}}}]))
    assert flat == {"Cluster/name": "x", "Cluster/tags": ["a", "b"], "Cluster/in/n": 1} and info == {"query": "a=1"}
    mapped = documents.FieldMapping({"When": "when"}, types={"when": "DATE"}).apply(spark.createDataFrame([("2026-01-02",), ("1000000000000",), ("bad",)], "When string"))
    assert [r.when for r in mapped.collect()] == [datetime.datetime(2026, 1, 2), datetime.datetime(2001, 9, 9, 1, 46, 40), None]
    rows = spark.createDataFrame([("a", "c", 1, "t"), ("b", "c", 2, "u")], "id string, collection string, version long, text string")
    assert documents.masked(rows, 0).columns == ["id", "collection", "version"] and documents.with_role(rows.withColumn("roles", F.array("id")), "a").count() == 1
    assert documents.page_info(41, 20, 10) == {"page": 3, "pages": 5, "first": 20, "last": 30}
    shingles = one.select(text.shingles(F.array(F.lit("the"), F.lit("of"), F.lit("fox")), 3)).first()[0]
    assert shingles == ["of fox", "the of fox"]


def test_collapsing_keeps_the_heaviest_phrases():
    assert clicks.collapse([("b c", 1.0, 1.0), ("a b c d", 4.0, 0.0), ("x", 9.0, 0.0)])[0][0] == "x"


def test_popular_queries_with_totals(spark):
    q = logs.with_time_tuple(spark.createDataFrame([("c", 0, w, 1) for w in ["a"] * 3 + ["b"] * 2 + ["d"]], "collection string, timestamp long, query string, hits int"))
    assert [(r["query"], r["count"], r["rank"], r["total"]) for r in logmetrics.popular_queries(q, 2).orderBy("rank").collect()] == [("a", 3, 1, 6), ("b", 2, 2, 6)]


def test_stream_restart_and_ingest_hours(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    t = datetime.datetime(2026, 1, 2, 3, 4)
    spark.createDataFrame([("a", t), ("b", t)], "value string, ingested timestamp").write.parquet(source)

    def consume():
        df = spark.readStream.schema("value string, ingested timestamp").parquet(source)
        streams.start(streams.by_ingest_hour(df), streams.hourly_writer(out), check).awaitTermination()
        return sorted((r.value, str(r.date), int(r.hour)) for r in spark.read.parquet(out).collect())

    assert consume() == [("a", "2026-01-02", 3), ("b", "2026-01-02", 3)]
    assert len(consume()) == 2  # offsets are remembered
    spark.createDataFrame([("c", t + datetime.timedelta(hours=1))], "value string, ingested timestamp").write.mode("append").parquet(source)
    assert consume()[-1] == ("c", "2026-01-02", 4) and len(consume()) == 3


def test_change_feed_counters_and_buffer(spark, tmp_path):
    counts = {}
    write = streams.change_writer(str(tmp_path / "feed"), counts)
    rows = spark.createDataFrame([("c", "1", "put"), ("c", "2", "put"), ("c", "3", "delete")], "collection string, id string, op string")
    write(rows, 0)
    write(rows.limit(1), 1)
    assert (counts["puts"], counts["deletes"], counts["last_batch"]) == (3, 1, 1) and spark.read.parquet(str(tmp_path / "feed")).count() == 4
    held = []
    buffer = streams.EventBuffer(held.extend, limit=3)
    buffer.record("a")
    buffer.buffering(True)
    buffer.record("b", "c")
    assert held == ["a"]
    buffer.record("d")  # full
    assert held == ["a", "b", "c", "d"]
    buffer.record("e")
    buffer.buffering(False)
    assert held[-1] == "e"
    good = spark.createDataFrame([("x", 2363233923), ("x", 1)], "value string, crc long")
    assert streams.verified(good).count() == 1
    q, c = logs.parse_click_events(spark.createDataFrame([(streams.query_log_line(5, "A b", "r", 2),), (streams.click_log_line(6, "r", "d", 1),)], "value string"))
    assert tuple(q.first()) == (5, "a b", "r", 2) and tuple(c.first()) == (6, "r", "d", 1)
    g = streams.gauges(spark.createDataFrame([("a",), ("a",), ("b",), ("logs",)], "collection string")).first()
    assert (g.collections, g.documents) == (2, 3)


def test_tail_and_sessions_as_streams(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "1.log").write_text("one\ntwo\n")
    (folder / "2.log").write_text("three\n")
    batches = []
    streams.start(streams.tail(spark, str(folder), files_per_batch=1), lambda b, n: batches.append(sorted(r.value for r in b.collect())), str(tmp_path / "c1")).awaitTermination()
    assert sorted(x for b in batches for x in b) == ["one", "three", "two"] and len(batches) == 2
    base = datetime.datetime(2026, 1, 1)
    at = lambda m: base + datetime.timedelta(minutes=m)
    schema, source = "ts timestamp, request_id string, kind string, value string", str(tmp_path / "events")
    spark.createDataFrame([(at(1), "r1", "C", "d1"), (at(0), "r1", "Q", "fox"), (at(2), "r1", "C", "d2"), (at(3), "r2", "C", "d3")], schema).coalesce(1).write.parquet(source)
    spark.createDataFrame([(at(600), "r9", "Q", "late")], schema).coalesce(1).write.mode("append").parquet(source)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = []
    streams.start(streams.reading_sessions(df), lambda b, n: found.extend((r.request_id, r["query"], list(r.clicks)) for r in b.collect()), str(tmp_path / "c2")).awaitTermination()
    assert found == [("r1", "fox", ["d1", "d2"])]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_row_similarity_multiplies_blocks_of_vectors(spark, monkeypatch, kind):
    import numpy as np

    rng = np.random.default_rng(3)
    cells = {(int(i), int(j)): float(rng.uniform(0.1, 2)) for i in range(70) for j in rng.zipf(1.4, 12) if j < 200}
    cells[(70, 999)] = 1.0  # shares no term
    dense = np.zeros((71, 1000))
    for (i, j), x in cells.items():
        dense[i, j] = x
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    want = {(a, b): x for (a, b), x in np.ndenumerate(dense @ dense.T) if a != b and x > 0}
    name = (lambda i: f"{i:02d}") if kind == "string" else (lambda i: i)
    w = spark.createDataFrame([(name(i), f"t{j}", x) for (i, j), x in cells.items()], f"doc_id {kind}, term string, weight double")
    for limits in ((2_000_000, 8192, 512, 1 << 19, 1 << 20), (40, 8192, 0, 30, 5), (2_000_000, 7, 6, 100, 40)):
        for limit, value in zip(("BLOCK_POSTINGS", "BLOCK_ROWS", "DENSE_TERMS", "PAIRS", "PRODUCTS"), limits, strict=True):
            monkeypatch.setattr(textmining, limit, value, raising=False)
        for queries, pairs in ((w.where("doc_id % 5 = 0"), {x for x in want if x[0] % 5 == 0}), (None, {x for x in want if x[0] < x[1]}), (w.where("doc_id = 'none'" if kind == "string" else "doc_id = -1"), set())):
            found = textmining.row_similarity(w, queries=queries)
            assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # products of single terms are no rows
            rows = found.collect()
            assert {(r.a, r.b) for r in rows} == {(name(a), name(b)) for a, b in pairs} and len(rows) == len(pairs)
            assert all(abs(r.score - want[int(r.a), int(r.b)]) < 1e-12 for r in rows)


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 16, 2_000_000, 8192), (30, 20, 60, 4)])
@pytest.mark.parametrize("odd", [True, False])
def test_text_similarity_is_row_similarity_of_tfidf(spark, monkeypatch, limits, odd):
    import random

    rng = random.Random(5)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(1, 60)))) for i in range(60)]
    if odd:  # keys that come again, one of them asked for; no key; no words; a term of one document
        docs += [(10, "w1 w2 w2 again again"), (10, "w5 again"), (11, "w1 w7 Again"), (None, "w1 w3 nameless nameless"), (None, "w3 nameless again"), (90, None), (100, "..."), (101, "alone alone w4"), (110, "single single")]
    t = textmining.tokenised(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    asked = t.where("doc_id % 10 = 0")
    want = {(r.a, r.b): r.score for r in textmining.row_similarity(textmining.tfidf(textmining.term_frequencies(t), t.count()), queries=asked).collect()}
    for limit, value in zip(("BLOCK_TERMS", "RUN", "BLOCK_POSTINGS", "BLOCK_ROWS"), limits, strict=True):
        monkeypatch.setattr(textmining, limit, value)
    rows = textmining.text_similarity(t, asked).collect()
    assert {(r.a, r.b) for r in rows} == set(want) and len(rows) == len(want) > 300
    assert all(abs(r.score - want[r.a, r.b]) < 1e-12 for r in rows)
    for none in (t.where("false"), t.where("doc_id = 90")):
        assert textmining.text_similarity(none, asked).count() == textmining.text_similarity(none, none).count() == 0
    assert textmining.text_similarity(t, t.where("false")).count() == 0


def test_row_similarity_query_keeps_to_its_disk(spark):
    import pathlib

    from quillmark import catalog, session

    def disk():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) + sum(f.stat().st_size for f in pathlib.Path(session.scratch(spark)).rglob("*.parquet"))

    session.shared_dir(spark)
    before = disk()
    catalog.QUERIES["m6_row_similarity"](spark, "/root/testdata/sf0.01").write.format("noop").mode("append").save()
    assert disk() - before < 4 * pathlib.Path("/root/testdata/sf0.01/documents.parquet").stat().st_size
