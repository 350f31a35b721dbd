"""Evaluation, alignment, graphs, read models, audio, stores, commands, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloq import __main__ as commands
from colloq.operators import audio, evaluation, graph, intervals, kernels, records, strategies, views
from colloq.shared import numbered_in_order
from colloq.sources import exports, files, stores
from colloq.streaming import live

SEG = "k int, seg int, start double, end double, label string"


def segs(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SEG)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    ("ref", "hyp", "collar", "wanted"),
    [
        ([(0.0, 2.0, "alice"), (2.0, 4.0, "bob")], [(0.0, 2.0, "spk1"), (2.0, 4.0, "spk2")], 0.0, (400, 0, 0, 0, 0.0)),
        ([(0.0, 2.0, "alice"), (2.0, 4.0, "bob")], [], 0.0, (400, 400, 0, 0, 1.0)),
        ([], [(0.0, 2.0, "spk1")], 0.0, (0, 0, 200, 0, 1.0)),
        ([(0.0, 2.0, "alice"), (2.0, 4.0, "bob")], [(0.0, 4.0, "alice")], 0.0, (400, 0, 0, 200, 0.5)),
        ([(0.0, 2.0, "a"), (2.0, 4.0, "b")], [(0.0, 2.2, "x"), (2.2, 4.0, "y")], 0.25, (300, 0, 0, 0, 0.0)),
        ([(0.0, 2.0, "a"), (2.0, 4.0, "b")], [(0.0, 2.2, "x"), (2.2, 4.0, "y")], 0.0, (400, 0, 0, 20, 0.05)),
    ],
)
def test_diarization(spark, ref, hyp, collar, wanted):
    got = evaluation.diarization_errors(segs(spark, *ref), segs(spark, *hyp), "k", collar=collar)
    assert [tuple(r)[1:] for r in got.collect()] == [wanted]


def test_purity_and_attribution(spark):
    two, one = segs(spark, (0.0, 2.0, "a"), (2.0, 4.0, "b")), segs(spark, (0.0, 4.0, "everyone"))
    assert rows(evaluation.purity_coverage_by(two, one, "k"), "purity", "coverage") == [(0.5, 1.0)]
    four = segs(spark, *[(float(i), i + 1.0, x) for i, x in enumerate("xyzw")])
    assert rows(evaluation.purity_coverage_by(segs(spark, (0.0, 4.0, "a")), four, "k"), "purity", "coverage") == [(1.0, 0.25)]
    assert rows(evaluation.purity_coverage_by(segs(spark, (0.0, 1.0, "a")), segs(spark, (0.0, 2.0, "x")), "k"), "purity", "coverage") == [(0.5, 1.0)]
    assert rows(evaluation.attribution(two, segs(spark, (0.0, 3.0, "p"), (3.0, 4.0, "q")), "k"), "n_total", "n_correct", "accuracy") == [(40, 30, 0.75)]


def test_error_rates(spark):
    pairs = [("السلام عليكم", "السلام عليكم ورحمة الله"), ("السلام عليكم ورحمة الله", "السلام عليكم"), ("السلام عليكم", "السلام جميعاً"), ("", "بعض الكلمات هنا"), ("الْعَرَبِيَّة", "العربية"), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, ref string, hyp string")
    got = {r["k"]: (r["substitutions"], r["deletions"], r["insertions"], r["rate"]) for r in evaluation.error_rates(df).collect()}
    assert got == {0: (0, 0, 2, 1.0), 1: (0, 2, 0, 0.5), 2: (1, 0, 0, 0.5), 3: (0, 0, 3, 1.0), 4: (0, 0, 0, 0.0), 5: (0, 0, 0, 0.0)}
    e = evaluation.evaluated(df.where("k = 2"), "k").first()
    assert e["wer_percent"] == 50.0 and 0 < e["cer_percent"] < 100 and e["saa_percent"] is None


def test_words_and_segments(spark):
    words = spark.createDataFrame([("c", 0, 0.0, 1.0), ("c", 0, 0.0, 1.0), ("c", 0, 1.0, 2.0), ("c", 1, 5.0, 6.0), ("c", 1, 8.0, 8.0), ("d", 0, 0.0, 1.0)], "call_id string, seg int, start double, end double")
    spoken = spark.createDataFrame([("c", 0, 0.0, 2.0), ("c", 1, 5.0, 9.0), ("d", 0, 0.0, 1.0)], "call_id string, seg int, start double, end double")
    who = spark.createDataFrame([("c", 0, 0.0, 1.2, "A"), ("c", 1, 6.5, 9.0, "B")], "call_id string, seg int, start double, end double, speaker_id string")
    assert rows(intervals.aligned_words(words, spoken, who), "call_id", "start", F.coalesce("speaker_id", F.lit("-"))) == [("c", 0.0, "A"), ("c", 0.0, "A"), ("c", 1.0, "A"), ("c", 5.0, "B"), ("c", 8.0, "B"), ("d", 0.0, "-")]
    pts = spark.createDataFrame([("c", 0), ("c", 5), ("c", 6), ("c", 99)], "call_id string, pos int")
    seg = spark.createDataFrame([("c", 0, 0, 6), ("c", 1, 6, 9)], "call_id string, idx int, at int, until int")
    assert rows(intervals.event_segments(pts, seg, "call_id", "pos"), "pos", F.coalesce("idx", F.lit(-1))) == [(0, 0), (5, 0), (6, 1), (99, -1)]
    m = spark.createDataFrame([(1, "s", 0.0, 1.0, "a", 0.5), (1, "s", 1.0, 4.0, "b", 0.9)], "k int, sp string, start double, end double, text string, c double")
    r = intervals.merge_runs(m, ["k"], ["sp"], 0.5, ["start"], "text", mean="c", parts=["text", "start"]).first()
    assert (r["text"], r["c"], [w["text"] for w in r["words"]]) == ("a b", pytest.approx(0.7), ["a", "b"])
    assert intervals.merge_runs(m, ["k"], ["sp"], 0.5, ["start"], weighted="c").first()["c"] == pytest.approx(0.8)


@pytest.fixture(scope="module")
def small(spark):
    """The graph of seven nodes and four edges."""
    n = [("Call:C1", "Call", "C1", 1, {}), ("Call:C2", "Call", "C2", 1, {}), ("Person:ahmad", "Person", "ahmad", 5, {}), ("Person:khaled", "Person", "khaled", 3, {}), ("Person:saeed", "Person", "saeed", 1, {}), ("Location:riyadh", "Location", "riyadh", 4, {}), ("Keyword:shipment", "Keyword", "shipment", 2, {"note": "watch"})]
    e = [("Person:ahmad", "Person:khaled", "MET_WITH", 1, ["C1"], {}), ("Person:khaled", "Person:saeed", "AGREED_WITH", 1, ["C2"], {}), ("Person:ahmad", "Location:riyadh", "WENT_TO", 1, ["C1"], {}), ("Call:C1", "Keyword:shipment", "MATCHES_WATCHLIST", 1, ["C1"], {"matched_text": "shipment"})]
    nodes = spark.createDataFrame([(*x, i) for i, x in enumerate(n)], "id string, type string, label string, mention_count int, props map<string,string>, seq int")
    return nodes, spark.createDataFrame(e, "source string, target string, type string, count long, call_ids array<string>, props map<string,string>")


def test_graph(spark, small):
    nodes, edges = small
    assert {(r["part"], r["type"]): r["n"] for r in graph.totals(nodes, edges).collect()}[("nodes", None)] == 7
    assert graph.top_entities(nodes, edges, "Person", 2).first()["label"] == "ahmad"
    assert graph.top_entities(nodes, edges, "Person", 1, "degree").first()["score"] == 2
    assert graph.shortest_path(edges, "Person:ahmad", "Person:saeed") == ["Person:ahmad", "Person:khaled", "Person:saeed"]
    assert [x["label"] for x in graph.path_between(edges, nodes, "ahm", "khaled")] == ["ahmad", "khaled"]
    assert graph.path_between(edges, nodes, "ahmad", "nobody") is None and graph.shortest_path(edges, "Person:ahmad", "Call:C1") is None
    assert graph.find_node(graph.upsert_nodes(nodes), "a").first()["id"] == "Person:ahmad"
    assert {r["id"]: r["score"] for r in graph.degree_centrality(edges, nodes).collect()}["Person:khaled"] == pytest.approx(2 / 6)
    assert rows(graph.persons_at(edges, "Location:riyadh"), "person") == [("Person:ahmad",)]
    assert rows(graph.watchlist_calls(edges, nodes), "call_id", "keyword", "matched_text", "note") == [("C1", "shipment", "shipment", "watch")]
    assert [r["size"] for r in graph.communities(edges, nodes).orderBy("rank").collect()] == [4, 2, 1]
    assert graph.communities(edges, nodes).orderBy("rank").first()["labels"] == ["ahmad", "khaled", "riyadh", "saeed"]
    said = edges.unionByName(spark.createDataFrame([("Speaker:S", "Keyword:shipment", "MENTIONED", 1, ["C1"], {})], edges.schema))
    assert graph.speakers_of_term(said, nodes.unionByName(spark.createDataFrame([("Speaker:S", "Speaker", "S", 1, {}, 9)], nodes.schema)), "ship").first()["id"] == "Speaker:S"
    assert graph.ingest_totals(nodes, edges, nodes.limit(0), edges).first().asDict() == {"nodes_added": 5, "edges_added": 0}
    assert graph.edges_of(edges, kind="WENT_TO").count() == 1 and graph.nodes_of(nodes, kind="Person").count() == 3
    e = edges.where("type != 'MATCHES_WATCHLIST'")
    c = graph.central_persons(e, nodes)
    assert [r["label"] for r in c.collect()] == ["khaled"]


def test_betweenness_by_joins(spark):
    r = np.random.default_rng(2)
    e = spark.createDataFrame(sorted({(f"n{a}", f"n{b}") for a, b in r.integers(0, 14, (40, 2)).tolist()}), "source string, target string")
    one, other = (dict((x["node"], x["score"]) for x in graph.betweenness(e, most, 5).collect()) for most in (10_000, 0))
    assert {k: v for k, v in one.items() if v} == pytest.approx({k: v for k, v in other.items() if v})


def test_graph_files(spark, small, tmp_path):
    nodes, edges = small
    stores.save_graph(nodes, edges, str(tmp_path / "g"))
    again = stores.load_graph(spark, str(tmp_path / "g"))
    assert again[1].count() == 4 and again[0].where("mention_count = 5").count() == 1
    assert exports.export_graph(nodes, edges, str(tmp_path / "x"), ["dot", "graphml", "cytoscape", "demo", "no"]) == ["dot", "graphml", "cytoscape", "demo"]
    text = lambda name: [r["value"] for r in getattr(exports, f"graph_{name}")(nodes, edges).collect()]
    assert text("dot")[0] == "digraph G {" and text("dot")[-1] == "}" and len(text("dot")) == 14
    import xml.etree.ElementTree as tree

    assert len(list(tree.fromstring("\n".join(text("graphml")).encode()).iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == 4
    ids = [json.loads(x)["data"]["id"] for x in text("cytoscape")]
    assert sorted(ids[-4:]) == ["e0", "e1", "e2", "e3"]
    assert exports.graph_demo(nodes, edges)[1].where("type = 'MET_WITH'").first()["label"] == "اجتمع بـ"
    assert stores.merge_statements(nodes, edges).count() == 11 and views.graph_document(nodes, edges).where("part = 'metadata'").first()["value"] == '{"node_count":7,"link_count":4}'
    assert rows(numbered_in_order(edges.select("source", "target"), ["target"], "i"), "i") == [(0,), (1,), (2,), (3,)]


def test_read_models(spark):
    log = spark.createDataFrame([("j1", 1, "a", 0.1), ("j1", 3, "b", 0.4), ("j2", 2, "a", 0.1)], "job_id string, at int, status string, progress double")
    assert [(r["job_id"], r["status"]) for r in views.recent_jobs(log).collect()] == [("j1", "b"), ("j2", "a")]
    up = spark.createDataFrame([("a.wav", 3), ("a.txt", 3), ("b.MP3", 0), (None, 1)], "n string, s int").select(views.upload_status(F.col("n"), F.col("s")).alias("x"))
    assert [r["x"] for r in up.collect()] == [200, 415, 400, 400]
    rep = spark.createDataFrame([("ok", 10.0, 8.0, ["little (3%)", "quiet"]), ("warning", 5.0, 0.0, ["little (9%)"])], "status string, duration double, speech double, warnings array<string>")
    s = views.processing_summary(rep).first()
    assert s["by_status"] == {"ok": 1, "warning": 1} and [(w["warning"], w["n"]) for w in s["common_warnings"]] == [("little", 2), ("quiet", 1)]
    seg = spark.createDataFrame([("c", 0, None, 0.0, 1.0, "x y", 0.9)], "call_id string, idx int, speaker_id string, start double, end double, text string, confidence double")
    assert views.call_details(seg, "c").first()["speaker_id"] == "UNKNOWN" and intervals.speaker_totals(seg).first()["n_words"] == 2


def test_audio(spark, tmp_path):
    s = files.made_audio(spark, 16_000).cache()
    by = {r["shape"]: r for r in s.join(audio.reports(s.drop("shape"), "id"), "id").collect()}
    assert by["silence"]["status"] == "warning" and "no speech" in by["silence"]["warnings"] and by["speech"]["n_segments"] >= 1
    assert by["clipped"]["clipping_ratio"] > 0.01 and by["quiet"]["issues"][0] == "quiet"
    speech = audio.speech_segments(s.where("shape = 'pauses'"), "id", "silero")
    assert [(r["seg"], round(r["start"], 1)) for r in speech.orderBy("seg").collect()][0] == (0, 0.0) and speech.agg(F.max("end")).first()[0] < 0.6
    e = audio.embedded(s, audio.speech_segments(s, "id"), "id").first()["embedding"]
    assert len(e) == 78 and abs(np.linalg.norm(e) - 1) < 1e-4
    folder = f"file://{tmp_path}/wav"
    assert files.save_audio(s.select("id", "samples"), folder, "id") == len(files.SHAPES)
    info = files.audio_info(spark, folder).collect()
    assert {(r["sample_rate"], r["channels"], r["bits"], r["frames"], r["error"]) for r in info} == {(16_000, 1, 16, 16_000, None)}
    back = files.signals(spark, folder).where("path like '%/0.wav'").first()
    assert np.allclose(back["samples"], s.where("id = 0").first()["samples"], atol=1e-4)
    for subtype in ("PCM_24",):
        assert np.allclose(files.decode_wav(files.encode_wav(np.array([0.5, -2.0, 1.0]), subtype=subtype))[0], [0.5, -1, 1], atol=1e-5)
    with pytest.raises(ValueError):
        files.wav_info(b"nothing")
    clips = spark.createDataFrame([("1", f"{tmp_path}/wav/0.wav", "train"), ("2", f"{tmp_path}/wav/1.wav", "test")], "clip_id string, audio_path string, split string")
    assert files.copy_split_files(clips, f"file://{tmp_path}/split") == 2 and files.copy_split_files(clips, f"file://{tmp_path}/split") == 0


def test_strategies(spark):
    with pytest.raises(ValueError, match="mock"):
        strategies.get("asr", "whisper")
    assert strategies.get("vad", "silero") is audio.energy_segments
    labels = kernels.without_small(np.array([0, 0, 0, 1, 2, 2]), np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0))), 2)
    assert labels.tolist() == [0, 0, 0, 2, 2, 2] or labels.tolist() == [0, 0, 0, 0, 2, 2]
    assert kernels.without_small(np.array([0, 1]), np.zeros((2, 2)), 5).tolist() == [0, 1]


def test_voices(spark):
    reg = spark.createDataFrame([("SPK_01", [1.0, 0.0, 0.0], 1)], "speaker_id string, centroid array<double>, n long")
    c = spark.createDataFrame([("a", 0, [0.99, 0.1, 0.0]), ("a", 1, [0.9, 0.43, 0.0]), ("b", 0, [0.0, 0.0, 2.0]), ("c", 5, [0.0, 0.1, 1.0])], "call_id string, cluster long, embedding array<double>")
    assigned, samples = records.auto_registered(reg, c)
    assert rows(assigned, "call_id", "cluster", "speaker_id", "status") == [("a", 0, "SPK_01", "known"), ("a", 1, "SPK_02", "new"), ("b", 0, "SPK_03", "new"), ("c", 5, "SPK_03", "known")]
    assert samples.count() == 4
    v = spark.createDataFrame([(i, [float(x) for x in np.eye(4)[i % 4] + i / 100]) for i in range(12)], "id int, embedding array<double>")
    x = {r["id"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in v.collect()}
    want = sorted((a, b) for a in x for b in x if a < b and x[a] @ x[b] >= 0.9)
    assert rows(records.similarities(v, "id", block=5), "a", "b") == want
    voices = spark.createDataFrame([(f"s{i}", [float(k) for k in np.eye(4)[i]]) for i in range(4)], "speaker_id string, centroid array<double>")
    q = v.withColumnRenamed("id", "item")
    assert rows(records.identify(q, voices, "item", part=1), "item", "rank", "speaker_id") == rows(records.identify(q, voices, "item"), "item", "rank", "speaker_id")
    assert records.identify(q, voices.limit(0), "item").count() == 0


def test_stores(spark, tmp_path):
    a = spark.createDataFrame([("c1", 1), ("c2", 2)], "call_id string, x int")
    stores.save_calls(a, str(tmp_path / "s"))
    stores.save_calls(a.where("call_id = 'c1'").withColumn("x", F.lit(7)), str(tmp_path / "s"))
    assert rows(stores.load_calls(spark, str(tmp_path / "s")), "call_id", "x") == [("c1", 7), ("c2", 2)] and stores.load_calls(spark, str(tmp_path / "s"), "c2").count() == 1
    stores.save_watchlist(spark.createDataFrame([(" a ", None), ("a", ""), ("", "")], "term string, note string"), str(tmp_path / "w"))
    assert rows(files.watchlist(spark, str(tmp_path / "w")), "term") == [("a",)]
    stores.save_registry(a.select(F.col("call_id").alias("speaker_id")), str(tmp_path / "r"))
    assert stores.load_registry(spark, str(tmp_path / "r")).first()["match_threshold"] == 0.85
    (tmp_path / "c.json").write_text('{"data": {"n": 2}}')
    assert files.config(str(tmp_path / "c.json"), data={"n": 1, "m": 3}) == {"data": {"n": 2, "m": 3}}
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.nlp.json").write_text('{"x": 1}')
    (tmp_path / "n/b.nlp.json").write_text("{broken")
    assert files.damaged(spark, str(tmp_path / "n")).count() == 1
    good, bad = files.analyses(spark, str(tmp_path / "n"), "x int")
    assert good.count() == 1 and bad.count() == 1


def test_commands(spark, tmp_path):
    clips = [{"clip_id": str(i), "duration_sec": 5.0, "speaker_id": f"s{i % 6}", "dialect": "d", "gender": "female", "transcript": "a b"} for i in range(30)]
    (tmp_path / "m.json").write_text(json.dumps({"version": "1", "clips": clips}))
    commands.main(["split", "--input", str(tmp_path / "m.json"), "--output", str(tmp_path / "out")], spark)
    assert spark.read.json(str(tmp_path / "out")).count() == 30
    with pytest.raises(SystemExit):
        commands.main(["validate", "--input", str(tmp_path / "m.json")], spark)
    commands.main(["calls", "--output", str(tmp_path / "calls"), "--n", "3"], spark)
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "calls/json")).collect()]
    assert len(docs) == 3 and all(d["n_segments"] == 8 for d in docs)
    assert records.manifest_document(files.manifest(spark, str(tmp_path / "m.json"))).first()["value"].startswith('{"version":"1.0"')
    assert records.usable_clips(files.manifest(spark, str(tmp_path / "m.json")), 1, arabic=True).count() == 0


def test_streams(spark, tmp_path):
    calls = spark.createDataFrame([("c1",), ("c2",)], "call_id string")
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    stages = {"diarization": lambda x: x, "asr": lambda x: x, "nlp": lambda x: x, "kg": lambda x: x}
    live.process_uploads(read(), str(tmp_path / "log"), str(tmp_path / "cp"), stages).awaitTermination()
    jobs = views.recent_jobs(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert {(r["call_id"], r["status"], r["progress"]) for r in jobs} == {("c1", "completed", 1.0), ("c2", "completed", 1.0)}

    def broken(x):
        raise RuntimeError("no model")

    live.process_uploads(read(), str(tmp_path / "log2"), str(tmp_path / "cp2"), stages | {"nlp": broken}).awaitTermination()
    assert {(r["status"], r["error"]) for r in views.recent_jobs(spark.read.parquet(str(tmp_path / "log2"))).collect()} == {("failed", "no model")}
    edges = spark.createDataFrame([("a", "b", "T", 1), ("a", "b", "T", 2), ("a", "c", "T", 1)], "source string, target string, type string, call_id long")
    for n in (1, 2):
        edges.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "e"))
        live.upsert_buckets(stream, str(tmp_path / "g"), str(tmp_path / "cp3"), live.merge_edges, ["source", "target", "type"], 8).awaitTermination()
        assert rows(live.read_buckets(spark, str(tmp_path / "g")), "source", "target", "count") == [("a", "b", 2 * n), ("a", "c", n)]
    c = spark.createDataFrame([("a", 0, [1.0, 0.0])], "call_id string, cluster long, embedding array<double>")
    for n in (0, 1):
        c.withColumn("call_id", F.lit(f"call{n}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
        live.register_stream(spark.readStream.schema(c.schema).parquet(str(tmp_path / "v")), str(tmp_path / "r"), str(tmp_path / "cp4")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "r/assigned/v1")), "speaker_id", "status") == [("SPK_01", "known")]
