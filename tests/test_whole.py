"""Queries whose whole job has no SQL, against brute force on the smallest tables."""

import collections
import os

import pyarrow.parquet as pq
import pytest

from colloq import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def read(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns)).to_pylist()


@pytest.fixture(scope="module")
def graph():
    who = {r["o_orderkey"]: f"c{r['o_custkey']}" for r in read("orders", "o_orderkey", "o_custkey")}
    near = collections.defaultdict(set)
    for r in read("lineitem", "l_orderkey", "l_suppkey"):
        if c := who.get(r["l_orderkey"]):
            near[c].add(f"s{r['l_suppkey']}")
            near[f"s{r['l_suppkey']}"].add(c)
    return near


def test_components_all(spark, graph):
    want = {}
    for start in sorted(graph):
        todo = [] if start in want else [start]
        while todo:
            if (v := todo.pop()) not in want:
                want[v] = start
                todo += graph[v]
    assert dict(catalogue.queries()["components_all"](spark, DATA).collect()) == want


def test_betweenness(spark, graph):
    want = dict.fromkeys(graph, 0.0)
    for s in graph:
        order, paths, depth = [s], collections.Counter({s: 1}), {s: 0}
        for v in order:
            for w in graph[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = collections.Counter()
        for w in reversed(order[1:]):
            want[w] += share[w]
            for v in graph[w]:
                if depth[v] == depth[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
    scale = (len(graph) - 1) * (len(graph) - 2)
    assert dict(catalogue.queries()["betweenness"](spark, DATA).collect()) == pytest.approx({k: v / scale for k, v in want.items()}, abs=2e-9)


def test_cer_all(spark):
    texts = [(r["item_id"], r["text"].lower()) for r in sorted(read("benchmark", "item_id", "text"), key=lambda r: r["item_id"])]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {i: distance(a, b) for (i, a), (_, b) in zip(texts, texts[1:])}
    assert len(want) == len(texts) - 1 and any("\n" in x or not x.isascii() for _, x in texts)
    assert dict(catalogue.queries()["cer_all"](spark, DATA).collect()) == want


def test_kg_build(spark):
    from colloq.operators import analysis, graph

    calls = [("C-001", 0, "SPK_01", "السلام عليكم، الشحنة جاهزة يوم الخميس"), ("C-001", 1, "SPK_02", "أرسل خالد الشحنة إلى الرياض يوم الخميس"), ("C-001", 2, "SPK_01", "اجتمع أحمد و خالد في جدة الساعة 9:30")]
    calls = spark.createDataFrame(calls, "call_id string, idx int, speaker_id string, text string")
    tables = analysis.calls_analysed(calls, spark.createDataFrame([("الشحنة", "")], "term string, note string"))
    edges = analysis.call_graph(calls, tables)[1].drop("props").cache()
    kinds = {r["type"] for r in edges.select("type").distinct().collect()}
    assert {"PARTICIPATED_IN", "MENTIONED_IN", "HAS_ACTOR", "OCCURRED_AT", "OCCURRED_ON", "MENTIONED", "MATCHES_WATCHLIST"} <= kinds
    actor = edges.where("type = 'HAS_ACTOR'").first()["target"]
    assert graph.timeline(edges, actor).count() > 0
