import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloq.operators import graph, intervals, kernels, records
from colloq.sources import exports, files
from colloq.streaming import live


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_diarization_errors(spark):
    s = lambda x: spark.createDataFrame(x, "k int, seg int, start double, end double, label string")
    ref = intervals.frame_labels(s([(1, 0, 0.0, 2.0, "a"), (1, 1, 2.0, 4.0, "b")]), ["k"])
    hyp = intervals.frame_labels(s([(1, 0, 0.0, 4.0, "a")]), ["k"])
    e = intervals.frame_errors(ref, hyp, ["k"]).first()
    assert (e["n_ref"], e["miss"], e["false_alarm"], e["confusion"]) == (400, 0, 0, 200)
    p = intervals.purity_coverage(ref.withColumnRenamed("label", "r").join(hyp.withColumnRenamed("label", "h"), ["k", "frame"]), "r", "h").first()
    assert p["purity"] == 0.5 and p["coverage"] == 1.0


def test_overlap_join_is_the_plain_join(spark):
    a = spark.createDataFrame([(1, i, float(i * 7 % 50), float(i * 7 % 50 + i % 9 + 1)) for i in range(40)], "k int, id int, start double, end double")
    b = spark.createDataFrame([(1, i, float(i * 5 % 50), float(i * 5 % 50 + i % 4 + 1)) for i in range(30)], "k int, id int, start double, end double")
    got = rows(intervals.overlap_join(a, b, "k", 10.0), "id", "r_id")
    x, y = a.collect(), b.collect()
    assert got == sorted((p["id"], q["id"]) for p in x for q in y if p["start"] < q["end"] and q["start"] < p["end"])


def test_islands_and_merges(spark):
    on = {0, 1, 2, 4, 5, 9}
    f = spark.createDataFrame([(1, i, i in on) for i in range(12)], "k int, frame int, speech boolean")
    assert rows(intervals.speech_islands(f, ["k"], 2, 2), "start", "end") == [(0, 6)]
    w = spark.createDataFrame([(1, 0, "s", 0.0, 0.5, "a"), (1, 1, "s", 0.5, 1.0, "b"), (1, 2, "s", 5.0, 5.5, "c")], "k int, idx int, sp string, start double, end double, text string")
    assert rows(intervals.merge_runs(w, ["k"], ["sp"], 0.6, ["idx"], "text"), "start", "end", "text") == [(0.0, 1.0, "a b"), (5.0, 5.5, "c")]


def test_assignment_is_the_best():
    r = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 4), (4, 2)):
        c = r.integers(0, 20, (n, m)).astype(float)
        got = sum(c[i, j] for i, j in enumerate(kernels.best_assignment(c)) if j >= 0)
        big, small = (c, (n, m)) if n <= m else (c.T, (m, n))
        assert got == max(sum(big[i, p[i]] for i in range(small[0])) for p in itertools.permutations(range(small[1]), small[0]))


def test_clusters():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.05, (10, 8)) + np.eye(8)[i] for i in range(3)])
    want = np.repeat([0, 1, 2], 10)
    assert (kernels.agglomerative(x, 3) == want).all() and (kernels.agglomerative(x, threshold=0.3) == want).all() and (kernels.spectral(x, 3) == want).all()
    assert abs(np.linalg.norm(kernels.mfcc_embedding(np.sin(np.arange(16000) * 0.1))) - 1) < 1e-5 and not kernels.mfcc_embedding(np.zeros(10)).any()


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string")
    assert rows(graph.components(e), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert rows(graph.distances(e, F.col("node") == "a"), "node", "distance") == [("a", 0), ("b", 1), ("c", 2)]
    assert {r["node"]: r["score"] for r in graph.betweenness(e).collect() if r["score"] > 0} == {"b": pytest.approx(1 / 12)}


def test_records(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "clip_id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "clip_id int, v string")
    assert rows(records.merge_manifests([a, b]), "clip_id", "v") == [(1, "x"), (2, "y"), (3, "w")]
    c = spark.range(200).select(F.col("id").alias("clip_id"), (F.col("id") % 20).alias("speaker_id"))
    s = records.split_by_speaker(c)
    assert s.count() == 200 and not records.leaked_speakers(s).count() and s.where("split = 'train'").count() == 160
    v = records.voiceprints(spark.createDataFrame([("p", [1.0, 0.0]), ("p", [0.99, 0.1]), ("p", [1.0, 0.05]), ("q", [0.0, 1.0])], "speaker_id string, embedding array<double>"))
    assert dict(rows(v, "speaker_id", "status")) == {"p": "stable", "q": "new"}
    got = records.assign_clusters(spark.createDataFrame([("k", 0, [1.0, 0.01]), ("k", 1, [0.9, 0.4])], "call_id string, cluster long, embedding array<double>"), v)
    assert rows(got, "cluster", "speaker_id") == [(0, "p"), (1, None)]


def test_exports_and_sources(spark, tmp_path):
    s = spark.createDataFrame([("c", 0, "S1", "أحمد", 0.5, 2.0, "مرحبا", 0.9), ("c", 1, "S2", "b", 2.0, 61.25, "x", 0.5)], "call_id string, idx int, speaker_id string, speaker_name string, start double, end double, text string, confidence double")
    assert exports.srt(s).first()["value"].startswith("1\n00:00:00,500 --> 00:00:02,000\nأحمد: مرحبا\n\n2\n")
    assert exports.txt(s).first()["value"] == "[00:00] أحمد: مرحبا\n[00:02] b: x [?]"
    assert exports.export(s, str(tmp_path / "o"), ["srt", "csv", "nothing"]) == ["srt", "csv"]
    (tmp_path / "m.json").write_text('{"version": "1", "clips": [{"clip_id": "1", "duration_sec": 2.5}, {"clip_id": "2", "duration_sec": 3.0}]}')
    m = files.manifest(spark, str(tmp_path / "m.json"))
    assert records.manifest_totals(m).first()["total_duration"] == 5.5 and m.first()["language"] == "ar"
    assert files.transcribe_mock(spark.createDataFrame([("c", 7.5)], "id string, duration double"), "id", ["a", "b"]).count() == 3


def test_stream_upserts(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "T", 1), ("a", "b", "T", 2), ("a", "c", "T", 1)], "source string, target string, type string, call_id long")
    edges.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in"))
    live.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), live.merge_edges).awaitTermination()
    edges.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.upsert_stream(spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), live.merge_edges).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out/v1")), "source", "target", "count") == [("a", "b", 3), ("a", "c", 1)]
