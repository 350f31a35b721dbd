"""Stored tables: the graph, voiceprints, watchlists, and what is kept for each call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables; counts and calls are kept as they are."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_registry(voices: DataFrame, path: str, match: float = 0.85, stable: float = 0.92) -> None:
    """Voiceprints with the thresholds that made them."""
    voices.withColumns({"match_threshold": F.lit(match), "stable_threshold": F.lit(stable)}).write.mode("overwrite").parquet(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Voiceprints; tables without thresholds have 0.55 and 0.75."""
    v = spark.read.parquet(path)
    for name, default in (("match_threshold", 0.55), ("stable_threshold", 0.75)):
        v = v if name in v.columns else v.withColumn(name, F.lit(default))
    return v


def save_watchlist(terms: DataFrame, path: str, version: str = "1.0") -> None:
    """One JSON document of the terms (term, note), each once; a watchlist is short."""
    own = terms.select(F.trim("term").alias("term"), F.coalesce("note", F.lit("")).alias("note")).where("term <> ''").dropDuplicates(["term"])
    doc = own.agg(F.array_sort(F.collect_list(F.struct("term", "note"))).alias("terms")).select(F.lit(version).alias("version"), "terms")
    doc.coalesce(1).write.mode("overwrite").json(path)


def save_calls(rows: DataFrame, path: str, key: str = "call_id") -> None:
    """Replaces what is stored of the calls in ``rows`` and leaves other calls as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def load_calls(spark: SparkSession, path: str, call_id=None, key: str = "call_id") -> DataFrame:
    """All calls, or one by its folder alone."""
    rows = spark.read.parquet(path)
    return rows if call_id is None else rows.where(F.col(key) == call_id)


def call_ids(*tables: DataFrame) -> DataFrame:
    """The ids that any of the tables knows, each once."""
    every = None
    for t in tables:
        ids = t.select("call_id")
        every = ids if every is None else every.unionByName(ids)
    return every.distinct()


def merge_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): a Cypher MERGE for each node, then for each edge, for a graph server's loader."""
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("MERGE (n:`"), F.col("type"), F.lit("` {id: "), quoted(F.col("id")), F.lit("}) SET n.label = "), quoted(F.col("label")), F.lit(", n.mention_count = "), F.col("mention_count").cast("string"), F.lit(";")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit("MATCH (a {id: "), quoted(F.col("source")), F.lit("}), (b {id: "), quoted(F.col("target")), F.lit("}) MERGE (a)-[r:`"), F.col("type"), F.lit("`]->(b) SET r.count = "), F.col("count").cast("string"), F.lit(";")).alias("value"))
    return n.unionByName(e)
