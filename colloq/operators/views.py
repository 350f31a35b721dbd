"""What is shown of calls, speakers, entities, jobs and the graph: projections and totals over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import graph
from .records import latest

#: Audio that an upload may be.
UPLOADS = (".wav", ".mp3", ".m4a", ".flac", ".ogg")


def upload_status(name: Column, length: Column) -> Column:
    """200, or why an upload is refused: 415 for another kind of file, 400 for an empty one or one without a name."""
    kind = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.when(F.coalesce(name, F.lit("")) == "", 400).when(~kind.isin(*UPLOADS), 415).when(F.coalesce(length, F.lit(0)) == 0, 400).otherwise(200)


def call_summaries(ids: DataFrame, calls: DataFrame, segments: DataFrame, hits: DataFrame, analysed: DataFrame) -> DataFrame:
    """One row per known call_id: call_id, duration, n_speakers, n_segments, status, has_nlp, watchlist_hits.

    ``calls`` (call_id, duration) have transcripts, ``analysed`` (call_id) have
    been analysed. A segment without a speaker counts as one speaker more.
    """
    speakers = F.count_distinct("speaker_id") + F.max(F.col("speaker_id").isNull().cast("int"))
    s = segments.groupBy("call_id").agg(F.count("*").alias("n_segments"), speakers.alias("n_speakers"))
    h = hits.groupBy("call_id").agg(F.count("*").alias("watchlist_hits"))
    out = ids.select("call_id").distinct().join(calls.select("call_id", "duration", F.lit("completed").alias("status")), "call_id", "left").join(s, "call_id", "left").join(h, "call_id", "left")
    out = out.join(analysed.select("call_id", F.lit(True).alias("has_nlp")).distinct(), "call_id", "left")
    return out.fillna({"duration": 0.0, "status": "pending", "n_segments": 0, "n_speakers": 0, "watchlist_hits": 0, "has_nlp": False})


def call_details(segments: DataFrame, call_id) -> DataFrame:
    """The segments of a call in order, with defaults for what is missing."""
    s = segments.where(F.col("call_id") == call_id).fillna({"speaker_id": "UNKNOWN", "confidence": 0.8, "text": ""})
    return s.withColumn("speaker_name", F.coalesce("speaker_name", F.lit("Unknown")) if "speaker_name" in s.columns else F.lit("Unknown")).orderBy("idx")


def with_reviews(rows: DataFrame, reviews: DataFrame, ident: Column, key: str = "entity_id") -> DataFrame:
    """``rows`` with their id and latest review: its status (pending without one), reviewer and time."""
    now = latest(reviews, [key], F.desc("reviewed_at")).select(key, *[c for c in ("review_status", "reviewed_by", "reviewed_at", "note") if c in reviews.columns])
    return rows.withColumn(key, ident).join(now, key, "left").withColumn("review_status", F.coalesce("review_status", F.lit("pending")))


def entity_rows(ents: DataFrame, reviews: DataFrame) -> DataFrame:
    return with_reviews(ents, reviews, tx.entity_id(F.col("call_id").cast("string"), F.col("type"), F.col("start").cast("string"), F.col("end").cast("string")))


def event_rows(evs: DataFrame, reviews: DataFrame) -> DataFrame:
    return with_reviews(evs, reviews, tx.event_id(F.col("call_id").cast("string"), F.col("sentence_start").cast("string"), F.col("action")))


def watchlist_rows(hits: DataFrame) -> DataFrame:
    """Watchlist matches of calls (call_id, term, text, start, end) with their ids."""
    ident = F.concat_ws(":", F.col("call_id").cast("string"), F.lit("wl"), F.col("start").cast("string"), F.col("term"))
    return hits.select(ident.alias("id"), "call_id", "term", F.coalesce("text", "term").alias("matched_text"), "start", "end")


def speaker_rows(voices: DataFrame, segments: DataFrame) -> DataFrame:
    """Voiceprints with the calls their speaker takes part in; none is an empty list."""
    calls = segments.where("speaker_id is not null").groupBy("speaker_id").agg(F.sort_array(F.collect_set("call_id")).alias("participated_in"))
    kind = calls.schema["participated_in"].dataType.simpleString()
    return voices.join(calls, "speaker_id", "left").withColumn("participated_in", F.coalesce("participated_in", F.array().cast(kind)))


def recent_jobs(log: DataFrame, k: int = 20) -> DataFrame:
    """The k jobs that changed last, each in its present state, from the log (job_id, at, ...)."""
    return latest(log, ["job_id"], F.desc("at"), F.desc("progress")).orderBy(F.desc("at"), "job_id").limit(k)


def service_info(ids: DataFrame, voices: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: calls, speakers, has_kg."""
    has = F.lit(nodes is not None and not nodes.isEmpty()).alias("has_kg")
    return ids.agg(F.count_distinct("call_id").alias("calls")).crossJoin(voices.agg(F.count_distinct("speaker_id").alias("speakers"))).select("*", has)  # one row each


def report(ids: DataFrame, voices: DataFrame, ents: DataFrame, evs: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """One row of totals, counts by type, and the k persons, places and keywords with most mentions."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    by = lambda df, name: df.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias(name))
    out = ids.agg(F.count_distinct("call_id").alias("total_calls")).crossJoin(voices.agg(F.count_distinct("speaker_id").alias("total_speakers")))
    parts = [count(ents, "total_entities"), count(evs, "total_events"), count(hits, "watchlist_alerts"), count(nodes, "total_kg_nodes"), count(edges, "total_kg_edges"), by(nodes, "nodes_by_type"), by(edges, "edges_by_type")]
    for kind, name in (("Person", "top_persons"), ("Location", "top_locations"), ("Keyword", "top_keywords")):
        parts.append(graph.top_entities(nodes, edges, kind, k).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias(name)))
    for part in parts:
        out = out.crossJoin(part)  # one row each
    return out


def processing_summary(reports: DataFrame, k: int = 5) -> DataFrame:
    """One row about processed files (status, duration, speech, warnings): counts by status, totals, and the k commonest warnings.

    Warnings are the same if they agree up to the first bracket.
    """
    kinds = reports.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    sums = reports.agg(F.count("*").alias("files"), F.sum("duration").alias("duration"), F.sum("speech").alias("speech"))
    said = reports.select(F.explode("warnings").alias("w")).select(F.trim(F.split("w", r"\(")[0]).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))
    top = said.orderBy(F.desc("n"), "warning").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "warning"))).alias("t"))
    common = top.select(F.transform("t", lambda x: F.struct(x["warning"].alias("warning"), (-x["neg"]).alias("n"))).alias("common_warnings"))
    return sums.withColumn("speech_ratio", F.when(F.col("duration") > 0, F.round(F.col("speech") / F.col("duration"), 4)).otherwise(0.0)).crossJoin(kinds).crossJoin(common)  # one row each


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the graph as JSON rows, nodes, links and one row of totals, for a reader that streams it."""
    n = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("*")).alias("value"))
    e = edges.select(F.lit("link").alias("part"), F.to_json(F.struct("*")).alias("value"))
    sums = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("link_count")))  # one row each
    return n.unionByName(e).unionByName(sums.select(F.lit("metadata").alias("part"), F.to_json(F.struct("*")).alias("value")))


def ranked_jobs(log: DataFrame) -> DataFrame:
    """Jobs in their present state, numbered within their status, the latest first."""
    now = latest(log, ["job_id"], F.desc("at"), F.desc("progress"))
    return now.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("at"), "job_id")))
