"""Sinks: transcripts and graphs as the text formats that people read, one row per call or line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import short_time, srt_time
from ..operators import strategies
from ..shared import numbered_in_order


def _joined(df: DataFrame, line: Column, between: str, key: str = "call_id") -> DataFrame:
    parts = df.select(key, "idx", line.alias("line"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), between).alias("value"))


def srt(segments: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("call_id").orderBy("idx"))
    line = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), F.col("speaker_name"), F.lit(": "), F.col("text"), F.lit("\n"))
    return _joined(segments.withColumn("n", n), line, "\n")


def vtt(segments: DataFrame) -> DataFrame:
    line = F.concat(srt_time(F.col("start"), "."), F.lit(" --> "), srt_time(F.col("end"), "."), F.lit("\n<v "), F.col("speaker_name"), F.lit(">"), F.col("text"), F.lit("\n"))
    return _joined(segments, line, "\n").withColumn("value", F.concat(F.lit("WEBVTT\n\nNOTE "), F.col("call_id").cast("string"), F.lit("\n\n"), F.col("value")))


def txt(segments: DataFrame, sure: float = 0.85) -> DataFrame:
    mark = F.when(F.col("confidence") <= sure, " [?]").otherwise("")
    line = F.concat(F.lit("["), short_time(F.col("start")), F.lit("] "), F.col("speaker_name"), F.lit(": "), F.col("text"), mark)
    return _joined(segments, line, "\n")


def speaker_slots(segments: DataFrame) -> DataFrame:
    """Adds speaker_slot: speakers of a call numbered from 0 by first appearance."""
    first = F.min("idx").over(Window.partitionBy("call_id", "speaker_id"))
    return segments.withColumn("_f", first).withColumn("speaker_slot", F.dense_rank().over(Window.partitionBy("call_id").orderBy("_f")) - 1).drop("_f")


def demo(segments: DataFrame) -> DataFrame:
    sure = F.round("confidence", 2) if "confidence" in segments.columns else F.lit(None).cast("double")
    name = F.col("speaker_name") if "speaker_name" in segments.columns else F.col("speaker_id")
    return speaker_slots(segments).select("call_id", "idx", name.alias("speaker_name"), (F.col("speaker_slot") + 1).alias("speaker_slot"), short_time(F.col("start")).alias("time_stamp"), "text", sure.alias("confidence"))


def json(segments: DataFrame) -> DataFrame:
    """One document per call with its segments in order."""
    in_order = lambda a, b: F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct(*[c for c in segments.columns if c != "call_id"])), in_order)
    g = segments.groupBy("call_id").agg(F.round(F.max("end"), 3).alias("duration_sec"), F.count("*").alias("n_segments"), listed.alias("segments"))
    return g.select("call_id", F.to_json(F.struct("*")).alias("value"))


def csv(segments: DataFrame) -> DataFrame:
    return segments.select("call_id", F.format_string("%.2f", "start").alias("start"), F.format_string("%.2f", "end").alias("end"), "speaker_id", "speaker_name", "text", F.format_string("%.4f", "confidence").alias("confidence"))


FORMATS = {"srt": srt, "vtt": vtt, "txt": txt, "csv": csv, "demo": demo, "json": json}
for _name, _format in FORMATS.items():
    strategies.register("export", _name, _format)


def export(segments: DataFrame, path: str, formats: list[str]) -> list[str]:
    """Writes the named formats below ``path``; unknown names are left out. Returns those written."""
    done = []
    for name in formats:
        if name in strategies.names("export"):
            out, w = strategies.get("export", name)(segments), f"{path}/{name}"
            out.write.csv(w, header=True) if name == "csv" else out.write.json(w) if name == "demo" else out.write.partitionBy("call_id").text(w)  # srt, vtt, txt, json: a folder a call
            done.append(name)
    return done


# Colours of node types and labels of edge types.
COLORS = {
    "Call": "#3b82f6", "Speaker": "#8b5cf6", "Person": "#10b981", "Location": "#f59e0b", "Organization": "#ec4899", "Date": "#06b6d4", "Time": "#06b6d4",
    "Money": "#84cc16", "Keyword": "#ef4444", "Event": "#6366f1", "Phone": "#94a3b8", "Email": "#94a3b8",
}
OTHER_COLOR = "#6b7280"
EDGE_LABELS = {
    "PARTICIPATED_IN": "شارك في", "MENTIONED_IN": "ذُكر في", "MENTIONED": "ذكر", "IDENTIFIED_AS": "هو", "HAS_ACTOR": "يشارك فيه", "OCCURRED_AT": "في",
    "OCCURRED_ON": "بتاريخ", "MET_WITH": "اجتمع بـ", "MET_AT": "اجتمع في", "AGREED_WITH": "اتفق مع", "CALLED": "اتصل بـ", "SENT_TO": "أرسل إلى",
    "RECEIVED_FROM": "استلم من", "WENT_TO": "ذهب إلى", "ARRIVED_AT": "وصل إلى", "MATCHES_WATCHLIST": "يحوي مصطلح", "SAME_AS": "هو نفسه", "INVOLVED_KEYWORD": "يتضمن",
}


def _lookup(pairs: dict[str, str], c: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c], default)


def graph_demo(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    more = ["props"] if "props" in nodes.columns else []
    n = nodes.select("id", "label", "type", _lookup(COLORS, F.col("type"), F.lit(OTHER_COLOR)).alias("color"), F.least(10 + 2 * F.col("mention_count"), F.lit(40)).alias("size"), *more)
    return n, edges.select("source", "target", "type", _lookup(EDGE_LABELS, F.col("type"), F.col("type")).alias("label"), F.col("count").alias("weight"))


def _framed(head: list[str], parts: list[DataFrame], tail: list[str]) -> DataFrame:
    """Lines (part, value) in order between a head and a tail; the sort is distributed."""
    spark = parts[0].sparkSession
    every = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(9, i, x) for i, x in enumerate(tail)], "part int, at int, value string")
    for i, part in enumerate(parts):
        every = every.unionByName(part.select(F.lit(1 + i).alias("part"), F.lit(0).alias("at"), "value"))
    return every.orderBy("part", "at", "value").select("value")


def graph_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT file in order."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    color = _lookup(COLORS, F.col("type"), F.lit(OTHER_COLOR))
    n = nodes.select(F.concat(F.lit("  "), quoted("id"), F.lit(" [label="), quoted("label"), F.lit(', color="'), color, F.lit('"];')).alias("value"))
    e = edges.select(F.concat(F.lit("  "), quoted("source"), F.lit(" -> "), quoted("target"), F.lit(" [label="), quoted("type"), F.lit("];")).alias("value"))
    return _framed(["digraph G {", "  rankdir=LR;"], [n, e], ["}"])


def graph_cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON element per row, nodes then edges, which are numbered e0, e1, ... in order."""
    n = nodes.select(F.to_json(F.struct(F.struct("id", "label", "type").alias("data"))).alias("value"))
    own = numbered_in_order(edges.select("source", "target", "type"), ["source", "target", "type"], "_i")
    ident = F.concat(F.lit("e"), F.col("_i").cast("string"))
    return n.unionByName(own.select(F.to_json(F.struct(F.struct(ident.alias("id"), "source", "target", "type").alias("data"))).alias("value")))


def graph_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file in order."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), safe(c), F.lit("</data>"))
    n = nodes.select(F.concat(F.lit('    <node id="'), safe("id"), F.lit('">'), data("label", F.col("label")), data("type", F.col("type")), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('    <edge source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('">'), data("relation", F.col("type")), data("count", F.col("count").cast("string")), F.lit("</edge>")).alias("value"))
    keys = [("label", "node", "string"), ("type", "node", "string"), ("relation", "edge", "string"), ("count", "edge", "long")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[f'  <key id="{k}" for="{of}" attr.name="{k}" attr.type="{t}"/>' for k, of, t in keys], '  <graph edgedefault="directed">']
    return _framed(head, [n, e], ["  </graph>", "</graphml>"])


GRAPH_FORMATS = {"dot": graph_dot, "graphml": graph_graphml, "cytoscape": graph_cytoscape}


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, formats: list[str]) -> list[str]:
    """Writes the graph below ``path``: text lines in order, and the demo's two tables of JSON rows. Returns the formats written."""
    done = []
    for name in formats:
        if name in GRAPH_FORMATS:
            GRAPH_FORMATS[name](nodes, edges).write.mode("overwrite").text(f"{path}/{name}")
        elif name == "demo":
            for part, rows in zip(("nodes", "links"), graph_demo(nodes, edges)):
                rows.write.mode("overwrite").json(f"{path}/demo/{part}")
        else:
            continue
        done.append(name)
    return done
