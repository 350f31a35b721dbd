"""Entities, coreference, keywords, watchlists, events: literal texts with their results."""

import pytest
from pyspark.sql import functions as F

from colloq.operators import analysis, language

CALL = [("C-1", 0, "SPK_01", "السلام عليكم، الشحنة جاهزة يوم الخميس"), ("C-1", 1, "SPK_02", "أرسل خالد الشحنة إلى الرياض يوم الخميس"), ("C-1", 2, "أحمد", "اجتمع أحمد و خالد في جدة الساعة 9:30")]


def texts(spark, *rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "k int, text string")


def found(spark, text, *columns):
    return {tuple(r) for r in language.entities(texts(spark, text), "k").select("type", "text", *columns).collect()}


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("قابل خالد القحطاني في الرياض", {("PERSON", "خالد القحطاني", 0.85), ("LOCATION", "الرياض", 0.9)}),
        ("الرياض مدينة", {("LOCATION", "الرياض", 0.75)}),
        ("محمد أحمد هنا", {("PERSON", "محمد أحمد", 0.85)}),
        ("وصل أبو محمد، أمس", {("PERSON", "أبو محمد", 0.92), ("DATE", "أمس", 0.8)}),
        ("بنت صغيرة", set()),
        ("خالد، هنا", set()),
        ("يعمل في شركة النور للتجارة", {("ORGANIZATION", "شركة النور للتجارة", 0.7)}),
        ("شركة واحد اثنان ثلاثة أربعة خمسة", set()),
        ("مستشفى الملك كبير", {("ORGANIZATION", "مستشفى الملك", 0.7)}),
        ("يوم الخميس، 12/3/2026", {("DATE", "الخميس", 0.85), ("DATE", "12/3/2026", 0.95)}),
        ("Mail A.B@x.org now", {("EMAIL", "A.B@x.org", 0.99)}),
    ],
)
def test_entities(spark, text, wanted):
    assert found(spark, text, "confidence") == wanted


def test_forms(spark):
    assert found(spark, "قابل خالد القحطاني في الرياض", "normalized") == {("PERSON", "خالد القحطاني", "خالد القحطاني"), ("LOCATION", "الرياض", "الرياض")}
    assert found(spark, "A.B@x.org", "normalized", "source", "context") == {("EMAIL", "A.B@x.org", "a.b@x.org", "rule", "A.B@x.org")}


def mentions(spark, *names):
    rows = [(1, "PERSON", n, 10 * i, 10 * i + len(n), 0.8 + i / 100, n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "k int, type string, text string, start int, end int, confidence double, normalized string")


@pytest.mark.parametrize(
    ("names", "wanted"),
    [
        (("a", "a b", "a c d"), {("a b", 2), ("a c d", 1)}),
        (("a", "a c d", "a b"), {("a b", 2), ("a c d", 1)}),
        (("a", "a b", "a b c", "a"), {("a b c", 4)}),
        (("x", "y z"), {("x", 1), ("y z", 1)}),
        (("b", "a b", "b c"), {("a b", 2), ("b c", 1)}),
    ],
)
def test_subnames(spark, names, wanted):
    got = language.entity_clusters(mentions(spark, *names), "k")
    assert {(r["canonical"], r["n"]) for r in got.collect()} == wanted


def test_clusters_of_a_key_named_k(spark):
    assert language.global_clusters(mentions(spark, "الدكتور أحمد", "أحمد")).collect()[0]["n"] == 2
    assert language.merged_duplicates(mentions(spark, "a", "a"), "k").first()["n"] == 2


def test_keywords(spark):
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate("delivery box delivery the box delivery".split())], "k int, pos int, token string")
    got = [tuple(r) for r in language.keywords(toks, "k", ["the"], lambda c: c).orderBy("rank").select("stem", "n", "score", "positions").collect()]
    assert got == [("delivery", 3, round(3 / 5 * 1.5, 5), [0, 2, 5]), ("box", 2, round(2 / 5 * 1.3, 5), [1, 4])]
    many = language.keywords(spark.range(30).selectExpr("1 as k", "cast(id as int) as pos", "'word' as token"), "k", [], lambda c: c).first()
    assert many["positions"] == list(range(10))
    g = {r["gram"]: (r["n"], r["score"]) for r in language.ngrams(toks, "k", 2, 2, ["the"], 5, lambda c: c).collect()}
    assert g == {"box delivery": (2, round(2 * 0.05 * 12 / 10, 5))} or "delivery box" in g
    p = language.key_phrases(texts(spark, "الكتاب والكتاب كتاب في البيت"), "k").orderBy("rank").first()
    assert (p["text"], p["n"]) == ("كتاب", 3)


def test_watchlist(spark):
    terms = language.watchlist_terms(spark.createDataFrame([("الشحنة", "x"), (" ", ""), ("إرسال", "")], "term string, note string"))
    hits = language.watchlist_hits(texts(spark, "الشحنة هنا والشحنة الشحنة"), terms, "k")
    assert sorted((r["start"], r["end"]) for r in hits.collect()) == [(0, 6), (19, 25)]
    lines = spark.createDataFrame([(1, 0, "a"), (1, 3, "الشحنة")], "k int, line_index int, text string")
    assert [tuple(r) for r in language.watchlist_line_hits(lines, terms, "k").select("k", "line_index", "term").collect()] == [(1, 3, "الشحنة")]
    assert language.watchlist_hits(texts(spark, "ارسال"), terms, "k").count() == 1


@pytest.fixture(scope="module")
def call(spark):
    s = spark.createDataFrame(CALL, "call_id string, idx int, speaker_id string, text string")
    tables = analysis.calls_analysed(s, spark.createDataFrame([("الشحنة", "n")], "term string, note string"))
    return s, tables


def test_call(call):
    s, tables = call
    meta = tables["metadata"].first()
    assert meta["text_length"] == sum(len(x[3]) + 1 for x in CALL) - 1 and meta["n_watchlist_matches"] == 2
    send = tables["enriched"].where("action = 'send'").first()
    assert (send["actors"], send["locations"], send["speaker_id"]) == (["خالد"], ["الرياض"], "SPK_02") or send["speaker_id"] is not None
    assert tables["segment_entities"].where("idx = 1 and type = 'LOCATION'").first()["text"] == "الرياض"
    doc = analysis.documents(s, tables).first()["value"]
    assert '"metadata"' in doc and "الشحنة" in doc


def test_call_graph(call):
    nodes, edges = (x.cache() for x in analysis.call_graph(*call))
    kinds = {r["type"]: r["n"] for r in nodes.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds["Call"] == 1 and kinds["Speaker"] == 3 and kinds["Keyword"] == 1 and kinds["Event"] >= 2
    types = {r["type"] for r in edges.select("type").distinct().collect()}
    assert {"PARTICIPATED_IN", "IDENTIFIED_AS", "MENTIONED_IN", "MENTIONED", "HAS_ACTOR", "OCCURRED_AT", "OCCURRED_ON", "MATCHES_WATCHLIST"} <= types
    assert edges.where("type = 'IDENTIFIED_AS'").first()["target"] == "Person:أحمد"
    ids = {r["id"] for r in nodes.collect()}
    assert all(r["source"] in ids and r["target"] in ids for r in edges.collect())
    part = edges.where("type = 'PARTICIPATED_IN' and source = 'Speaker:SPK_01'").first()
    assert part["count"] == 1 and part["call_ids"] == ["C-1"]
