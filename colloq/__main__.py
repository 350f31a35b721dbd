"""Commands over files: ``python -m colloq <command> --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import analysis, audio, evaluation, graph, intervals, kernels, records, views
from .sources import exports, files, stores


def split(spark, a) -> None:
    clips = files.manifest(spark, a.input)
    done = records.split_by_speaker(clips, a.train, a.val, a.seed) if a.by == "speaker" else records.split_random(clips, a.train, a.val, a.seed)
    done.write.mode("overwrite").partitionBy("split").json(a.output)
    records.split_stats(done, full=True).show(truncate=False)


def validate(spark, a) -> None:
    report = records.validation_report(files.manifest(spark, a.input)).collect()  # one row a rule
    for row in report:
        print(f"{row['level']:5} {row['check']} {row['value']}")
    bad = {"error", "warn"} if a.strict else {"error"}
    raise SystemExit(any(row["level"] in bad for row in report))


def calls(spark, a) -> None:
    made = files.made_calls(spark, a.n, seed=a.seed)
    print(exports.export(made, a.output, a.formats.split(",")))


def process(spark, a) -> None:
    signals = files.signals(spark, a.input)
    reports = audio.reports(signals, "path")
    reports.drop("issues", "warnings").write.mode("overwrite").json(a.output)
    views.processing_summary(reports.select("status", "duration", F.col("total_speech").alias("speech"), "warnings")).show(truncate=False)


def diarize(spark, a) -> None:
    signals = files.signals(spark, a.input).where("error is null")
    pieces = intervals.subsegments(audio.speech_segments(signals, "path")).drop("seg", "piece")
    pieces = pieces.withColumn("seg", F.xxhash64("path", "start"))
    own = audio.embedded(signals, pieces, "path")
    labels = kernels.cluster(own.where(F.exists("embedding", lambda x: x != 0)), "path", "seg", "embedding", a.method, threshold=a.threshold) if a.method == "agglomerative" else kernels.cluster(own, "path", "seg", "embedding", a.method)
    placed = own.drop("embedding").join(labels, ["path", "seg"])
    intervals.merge_runs(placed, ["path"], ["cluster"], 0.5, ["start"]).drop("run").write.mode("overwrite").json(a.output)


def extract(spark, a) -> None:
    segments = files.segments(spark, a.input).drop("words")
    watchlist = files.watchlist(spark, a.watchlist) if a.watchlist else None
    tables = analysis.calls_analysed(segments, watchlist)
    analysis.documents(segments, tables).write.mode("overwrite").json(f"{a.output}/documents")
    nodes, edges = analysis.call_graph(segments, tables)
    stores.save_graph(nodes, edges, f"{a.output}/graph")
    print(exports.export_graph(nodes, edges, f"{a.output}/exports", a.formats.split(",")))


def show(spark, a) -> None:
    nodes, edges = stores.load_graph(spark, a.input)
    graph.totals(nodes, edges).show(truncate=False)
    for kind in ("Person", "Location", "Keyword"):
        graph.top_entities(nodes, edges, kind, a.k).show(truncate=False)


def evaluate(spark, a) -> None:
    text = lambda path: analysis.joined_texts(files.segments(spark, path))
    pairs = text(a.input).withColumnRenamed("text", "ref").join(text(a.hypothesis).withColumnRenamed("text", "hyp"), "call_id", "left")
    evaluation.evaluated(pairs, "call_id").show(truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="colloq")
    sub = parser.add_subparsers(dest="command", required=True)
    one = lambda f, **more: (p := sub.add_parser(f.__name__), p.set_defaults(run=f), [p.add_argument(f"--{k}", **v) for k, v in more.items()])
    path = {"required": True}
    share = lambda x: {"type": float, "default": x}
    one(split, input=path, output=path, by={"choices": ["speaker", "random"], "default": "speaker"}, train=share(0.8), val=share(0.1), seed={"type": int, "default": 42})
    one(validate, input=path, strict={"action": "store_true"})
    one(calls, output=path, n={"type": int, "default": 10}, seed={"type": int, "default": 42}, formats={"default": "txt,srt,vtt,json,csv"})
    one(process, input=path, output=path)
    one(diarize, input=path, output=path, method={"choices": ["agglomerative", "spectral"], "default": "agglomerative"}, threshold=share(0.3))
    one(extract, input=path, output=path, watchlist={}, formats={"default": "demo,dot"})
    one(show, input=path, k={"type": int, "default": 10})
    one(evaluate, input=path, hypothesis=path)
    a = parser.parse_args(argv)
    a.run(spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
