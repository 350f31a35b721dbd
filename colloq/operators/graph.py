"""Property graphs as two tables: nodes (id, type, label, ...) and edges (source, target, type, ...)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons
from ..functions.text import node_id
from ..shared import durable

#: Types that a plain name may mean, in order of preference.
NAMED = ("Person", "Location", "Organization", "Date", "Time")
#: Edges up to which betweenness gives a component to a task whole (8 bytes an edge); beyond, frontiers are joined.
MOST_SHARED_EDGES = 2_000_000
#: Sources that a task searches in one component.
SOURCES_A_TASK = 1024


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One row per id from (id, type, label, mention_count, seq, props or not).

    Counts add up, the first label holds, the last properties hold; ``seq`` is
    that of the first insertion, so the result can be upserted again.
    """
    last = [F.max_by("props", "seq").alias("props")] if "props" in rows.columns else []
    return rows.groupBy("id").agg(F.min_by("type", "seq").alias("type"), F.min_by("label", "seq").alias("label"), F.sum("mention_count").alias("mention_count"), F.min("seq").alias("seq"), *last)


def upsert_edges(rows: DataFrame) -> DataFrame:
    """One row per (source, target, type) from rows with call_id: how often, and in which calls; the first properties hold."""
    first = [F.min_by("props", "seq").alias("props")] if "props" in rows.columns else []
    return rows.groupBy("source", "target", "type").agg(F.count("*").alias("count"), F.sort_array(F.collect_set("call_id")).alias("call_ids"), *first)


def sound_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def _props(**columns: Column) -> Column:
    known = F.map_from_entries(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.cast("string").alias("value"))) for k, c in columns.items()])))
    return known.alias("props")


def _nodes(rows: DataFrame, kind: Column | str, name: Column, label: Column, call: str, at: Column, props: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    seq = F.struct(F.col(call).cast("string").alias("call"), at.cast("double").alias("at"))
    return rows.select(node_id(kind, name).alias("id"), kind.alias("type"), label.alias("label"), F.lit(1).alias("mention_count"), seq.alias("seq"), props)


def _edges(rows: DataFrame, source: Column, target: Column, kind: Column | str, at: Column, **props: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    seq = F.struct(F.col("call_id").cast("string").alias("call"), at.cast("double").alias("at"))
    return rows.select(source.alias("source"), target.alias("target"), kind.alias("type"), "call_id", seq.alias("seq"), _props(**props) if props else F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")).alias("props"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _speaker(df: DataFrame) -> Column:
    """The speaker's id, else the name, else UNKNOWN."""
    names = [F.when(F.col(c) != "", F.col(c)) for c in ("speaker_id", "speaker_name") if c in df.columns]
    return F.coalesce(*names, F.lit("UNKNOWN"))


def _column(df: DataFrame, name: str, default=None) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def calls_to_graph(ents: DataFrame, triples: DataFrame, segments: DataFrame, events: DataFrame | None = None, hits: DataFrame | None = None, said: DataFrame | None = None, said_hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of calls, each with properties; edges need both ends.

    * ``segments`` (call_id, speaker_id, idx, speaker_name or not): Call and
      Speaker nodes, PARTICIPATED_IN; a speaker whose id is a name, not a
      number (SPK_..), is IDENTIFIED_AS a Person.
    * ``ents`` (call_id, type, normalized, text, start): their nodes, MENTIONED_IN.
    * ``said`` (call_id, speaker_id, type, normalized): a speaker MENTIONED an entity of ``ents``.
    * ``events`` (call_id, speaker_id, sentence_start in the call, sentence, action, actors, locations, times):
      Event nodes, HAS_ACTOR, OCCURRED_AT, OCCURRED_ON, a speaker MENTIONED them.
    * ``hits`` (call_id, term, note or not): Keyword nodes, MATCHES_WATCHLIST; ``said_hits``
      (call_id, speaker_id, term): a speaker MENTIONED the keyword.
    * ``triples`` (call_id, subject, relation, object): edges between the nodes of those names.
    """
    name = lambda kind, x: node_id(F.lit(kind), x)
    call = name("Call", F.col("call_id").cast("string"))
    zero = F.lit(0)
    s = segments.withColumn("_who", _speaker(segments)).withColumn("_name", F.coalesce(F.nullif(_column(segments, "speaker_name").cast("string"), F.lit("")), "_who"))
    e = ents.withColumn("_kind", _map(lexicons.NODE_TYPES)[F.col("type")]).where("_kind is not null").withColumn("_form", F.coalesce(F.nullif("normalized", F.lit("")), "text"))
    known = s.where(~F.col("_who").startswith("SPK_") & (F.col("_name") == F.col("_who")))
    sizes = segments.groupBy("call_id").agg(F.count("*").alias("n"))
    nodes = [
        _nodes(sizes, "Call", F.col("call_id").cast("string"), F.col("call_id").cast("string"), "call_id", F.lit(-1), _props(n_segments=F.col("n"))),
        _nodes(s, "Speaker", F.col("_who"), F.col("_name"), "call_id", F.col("idx"), _props(n_segments=F.lit(1))),
        _nodes(known, "Person", F.col("_name"), F.col("_name"), "call_id", F.col("idx"), _props(is_speaker=F.lit("true"))),
        _nodes(e, F.col("_kind"), F.col("_form"), F.col("text"), "call_id", F.col("start"), _props(type=F.col("type"), confidence=_column(ents, "confidence").cast("string"), source=_column(ents, "source").cast("string"))),
    ]
    edges = [
        _edges(s, name("Speaker", F.col("_who")), call, "PARTICIPATED_IN", F.col("idx")),
        _edges(known, name("Speaker", F.col("_who")), name("Person", F.col("_name")), "IDENTIFIED_AS", F.col("idx"), confidence=F.lit(0.9)),
        _edges(e, node_id(F.col("_kind"), F.col("_form")), call, "MENTIONED_IN", F.col("start")),
    ]
    if said is not None:
        m = said.withColumn("_who", _speaker(said)).withColumn("_kind", _map(lexicons.NODE_TYPES)[F.col("type")]).where("_kind is not null")
        edges.append(_edges(m, name("Speaker", F.col("_who")), node_id(F.col("_kind"), F.col("normalized")), "MENTIONED", zero))
    if events is not None:
        ev = events.withColumn("_id", name("Event", F.concat_ws("_", "call_id", "sentence_start", "action"))).withColumn("_shown", F.substring("sentence", 1, 50))
        at = F.col("sentence_start")
        told = _props(action=F.col("action"), sentence=F.substring("sentence", 1, 100), verb_text=_column(events, "verb").cast("string"), confidence=_column(events, "confidence").cast("string"))
        nodes.append(_nodes(ev, "Event", F.concat_ws("_", "call_id", "sentence_start", "action"), F.concat("action", F.lit(": "), "_shown"), "call_id", at, told))
        for column, kind, edge in (("actors", "Person", "HAS_ACTOR"), ("locations", "Location", "OCCURRED_AT"), ("times", "Date", "OCCURRED_ON"), ("times", "Time", "OCCURRED_ON")):
            each = ev.select("call_id", "_id", "sentence_start", F.explode(column).alias("_x"))
            edges.append(_edges(each, F.col("_id"), name(kind, F.col("_x")), edge, at))
        if "speaker_id" in events.columns:
            edges.append(_edges(ev.where("speaker_id is not null"), name("Speaker", F.col("speaker_id")), F.col("_id"), "MENTIONED", at))
    if hits is not None:
        nodes.append(_nodes(hits, "Keyword", F.col("term"), F.col("term"), "call_id", zero, _props(is_watchlist=F.lit("true"), note=_column(hits, "note").cast("string"))))
        edges.append(_edges(hits, call, name("Keyword", F.col("term")), "MATCHES_WATCHLIST", zero, matched_text=_column(hits, "text").cast("string"), position=_column(hits, "start").cast("string")))
        if said_hits is not None:
            edges.append(_edges(said_hits, name("Speaker", _speaker(said_hits)), name("Keyword", F.col("term")), "MENTIONED", zero))
    nodes = durable(upsert_nodes(_union(nodes)))
    t = triples.withColumn("_type", _map(lexicons.RELATION_EDGES)[F.col("relation")]).where("_type is not null")
    ids = typed_names(t.select(F.col("subject").alias("name")).unionByName(t.select(F.col("object").alias("name"))).distinct(), nodes)
    t = t.join(ids.select(F.col("name").alias("subject"), F.col("id").alias("_s")), "subject").join(ids.select(F.col("name").alias("object"), F.col("id").alias("_o")), "object")
    edges.append(_edges(t, F.col("_s"), F.col("_o"), F.col("_type"), zero))
    return nodes, sound_edges(upsert_edges(_union(edges)), nodes)


def typed_names(names: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = NAMED) -> DataFrame:
    """(name, id): the node that a plain name means, the first of ``kinds`` that has one; names without a node are left out."""
    tries = names.select("name", F.posexplode(F.array(*[F.lit(k) for k in kinds])).alias("_order", "_kind")).withColumn("id", node_id(F.col("_kind"), F.col("name")))
    return tries.join(nodes.select("id").distinct(), "id", "left_semi").groupBy("name").agg(F.min_by("id", "_order").alias("id"))


def ingest_totals(nodes: DataFrame, edges: DataFrame, old_nodes: DataFrame, old_edges: DataFrame) -> DataFrame:
    """One row: how many nodes and edges a batch adds to a graph; Call nodes are not counted."""
    fresh = nodes.where("type <> 'Call'").join(old_nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("nodes_added"))
    keys = ["source", "target", "type"]
    more = edges.join(old_edges.select(keys), keys, "left_anti").agg(F.count("*").alias("edges_added"))
    return fresh.crossJoin(more)  # one row each


def edges_of(edges: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None) -> DataFrame:
    for column, value in (("source", source), ("target", target), ("type", kind)):
        edges = edges if value is None else edges.where(F.col(column) == value)
    return edges


def nodes_of(nodes: DataFrame, ident: str | None = None, kind: str | None = None) -> DataFrame:
    nodes = nodes if ident is None else nodes.where(F.col("id") == ident)
    return nodes if kind is None else nodes.where(F.col("type") == kind)


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, type, n): counts by type of node and edge; a null type is the sum."""
    return nodes.rollup("type").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("part"), "type", "n").unionByName(edges.rollup("type").agg(F.count("*").alias("n")).select(F.lit("edges").alias("part"), "type", "n"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other), each edge from either end."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other")))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("other").alias("neighbors"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, score): edge ends at a node over the number of other nodes; nodes without edges have 0, a lone node 1."""
    n = nodes.agg(F.count("*").alias("_n"))
    ends = both_ways(edges).groupBy("node").agg(F.count("*").alias("_d"))
    own = nodes.select("id").join(ends, F.col("id") == F.col("node"), "left").crossJoin(n)  # the right side is one row
    return own.select("id", F.when(F.col("_n") > 1, F.coalesce("_d", F.lit(0)) / (F.col("_n") - 1)).otherwise(1.0).alias("score"))


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge between two nodes; component is the least node reachable.

    Large-star and small-star steps alternate until nothing changes. Every
    step is a grouped minimum (combined before the shuffle) and a join with one
    row per node on the smaller side, so a node with very many neighbours is
    split by adaptive skew joins and never gathered. Each round is written to
    the shared folder; a count and a checksum come to the driver, no link does.
    Self links and rows with a null end are ignored; without edges the result is empty.
    """
    a, b = F.col(left), F.col(right)
    edges = durable(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = _print_of(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = durable(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) over edges (source, target), whatever their direction."""
    return connected(edges, "source", "target")


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, size, labels): connected groups of nodes with their sorted labels, largest first in ``rank``; a node without edges is a group."""
    own = nodes.select("id", "label").join(components(edges), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    g = own.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("label")).alias("labels"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")))  # one row a group


def distances(edges: DataFrame, start: Column, most: int | None = None, until: str | None = None) -> DataFrame:
    """(node, distance, parent) from the nodes where ``start`` holds, ignoring direction: a frontier join per step, seen nodes left out.

    The parent is the least node one step nearer (null at the start). ``most``
    ends after so many steps, ``until`` when that node is reached.
    """
    links = durable(both_ways(edges).distinct())
    kind = links.schema["node"].dataType.simpleString()
    seen = durable(links.where(start).select("node").distinct().withColumns({"distance": F.lit(0), "parent": F.lit(None).cast(kind)}))
    frontier, d = seen, 0
    while most is None or d < most:
        d += 1
        step = frontier.select(F.col("node").alias("parent")).join(links.select(F.col("node").alias("parent"), F.col("other").alias("node")), "parent")
        frontier = durable(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("parent").alias("parent")).select("node", F.lit(d).alias("distance"), "parent"))
        if frontier.isEmpty():
            break
        seen = durable(seen.unionByName(frontier))
        if until is not None and not frontier.where(F.col("node") == until).isEmpty():
            break
    return seen


def shortest_path(edges: DataFrame, source: str, target: str) -> list[str] | None:
    """The nodes of a shortest path, ignoring direction; of several the one whose nodes, from the end, are least. None if there is none."""
    if source == target:
        return [source] if not both_ways(edges).where(F.col("node") == source).isEmpty() else None
    found = distances(edges, F.col("node") == source, until=target)
    path, at = [target], found.where(F.col("node") == target).first()
    if at is None:
        return None
    while at["parent"] is not None:  # one look-up for each step of the path
        path.append(at["parent"])
        at = found.where(F.col("node") == at["parent"]).first()
    return path[::-1]


def path_between(edges: DataFrame, nodes: DataFrame, source_label: str, target_label: str, kind: str = "Person") -> list[dict] | None:
    """The nodes of a shortest path between the first nodes of ``kind`` that bear the labels; None without a node or a path."""
    ends = [find_node(nodes.where(F.col("type") == kind), x).first() for x in (source_label, target_label)]
    if None in ends:
        return None
    ids = shortest_path(edges, ends[0]["id"], ends[1]["id"])
    if ids is None:
        return None
    own = {r["id"]: r.asDict(recursive=True) for r in nodes.where(F.col("id").isin(ids)).collect()}  # the nodes of one path
    return [own[i] for i in ids if i in own]


def betweenness(edges: DataFrame, most_shared: int = MOST_SHARED_EDGES, sources: int = 4096) -> DataFrame:
    """(node, score): exact directed betweenness, normalised; parallel edges count once.

    No shortest path leaves a connected component, so each is searched alone:
    one of up to ``most_shared`` edges goes as two arrays to the tasks that
    share its sources, and no edge or name comes to the driver. Larger ones are
    searched by joins of frontiers, about ``sources`` sources at a time
    (:func:`betweenness_by_joins`).
    """
    pairs = durable(edges.select("source", "target").where("source != target").distinct())
    loops = edges.select("source").where("source = target").distinct()  # a node with a loop alone is a node
    of = connected(pairs, "source", "target")
    own = durable(of.withColumn("i", F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1))
    n = own.count() + loops.join(own.select(F.col("node").alias("source")), "source", "left_anti").count()
    ends = pairs.join(own.withColumnRenamed("node", "source"), "source").join(own.select(F.col("node").alias("target"), F.col("i").alias("j")), "target")
    sizes = durable(ends.groupBy("component").agg(F.count("*").alias("m")))
    small, large = sizes.where(F.col("m") <= most_shared).select("component"), sizes.where(F.col("m") > most_shared).select("component")
    parts = []
    if not small.isEmpty():
        arrays = ends.join(small, "component", "left_semi").groupBy("component").agg(F.collect_list("i").alias("source"), F.collect_list("j").alias("target"))
        members = own.groupBy("component").agg(F.count("*").alias("n"))
        packed = durable(arrays.join(members, "component"))
        blocks = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SOURCES_A_TASK).cast("int"))
        many = packed.agg(F.sum(F.size(blocks))).first()[0]
        kind = packed.schema["component"].dataType.simpleString()
        dealt = packed.withColumn("block", F.explode(blocks)).repartition(min(many, 4096))
        found = dealt.mapInPandas(_searched, f"component {kind}, i int, score double").groupBy("component", "i").agg(F.sum("score").alias("score"))
        parts.append(found.join(own, ["component", "i"]).select("node", (F.col("score") * _scale(n)).alias("score")))
    if not large.isEmpty():
        parts.append(betweenness_by_joins(durable(ends.join(large, "component", "left_semi").select("source", "target")), sources, n))
    return _union(parts) if parts else pairs.select(F.col("source").alias("node"), F.lit(0.0).alias("score")).limit(0)


def _searched(batches):
    """(component, i, score) from rows (component, source, target, n, block): dependencies of the block's sources on every node that they reach."""
    size = 16
    for pdf in batches:
        for component, source, target, n, block in zip(pdf["component"], pdf["source"], pdf["target"], pdf["n"], pdf["block"]):
            ends = np.stack([np.asarray(source, np.int32), np.asarray(target, np.int32)])
            into, out = ends[:, np.lexsort((ends[0], ends[1]))], ends[:, np.lexsort((ends[1], ends[0]))]
            total, seen = np.zeros(n), np.zeros(n, bool)
            first, last = block * SOURCES_A_TASK, min(n, (block + 1) * SOURCES_A_TASK)
            for lo in range(first, last, size):
                _dependencies(np.arange(lo, min(lo + size, last)), into, out, total, seen)
            at = np.flatnonzero(seen)
            if len(at):
                yield pd.DataFrame({"component": [component] * len(at), "i": at.astype(np.int32), "score": total[at]})


def _scale(n: int) -> float:
    return 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0


def betweenness_by_joins(pairs: DataFrame, sources: int = 4096, count: int | None = None) -> DataFrame:
    """The same from distinct directed edges, for graphs of any size: (source, node) frontiers are joined with the edges level by level.

    Sources are dealt by hash to runs of about ``sources``; a run holds one row
    for each source and node that it reaches, spread over the cluster. Path
    counts go forward, dependencies come back a level at a time.
    """
    nodes = durable(both_ways(pairs).select("node").distinct())
    n = nodes.count()
    runs = max(1, -(-n // sources))
    n = count or n  # of the whole graph, of which these may be some components
    out = pairs.select(F.col("source").alias("node"), F.col("target").alias("next"))
    total = None
    for k in range(runs):
        own = nodes.where(F.pmod(F.xxhash64("node"), F.lit(runs)) == k)
        levels = [durable(own.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))]
        seen = levels[0].select("s", "node")
        while True:
            step = levels[-1].join(out, "node").groupBy("s", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
            level = durable(step.join(seen, ["s", "node"], "left_anti"))
            if level.isEmpty():
                break
            levels.append(level)
            seen = durable(seen.unionByName(level.select("s", "node")))
        share = levels[-1].withColumn("share", F.lit(0.0))
        for at in range(len(levels) - 1, 0, -1):
            part = share.where("s != node").select("node", "share")
            total = part if total is None else total.unionByName(part)
            give = share.select("s", F.col("node").alias("next"), ((1 + F.col("share")) / F.col("paths")).alias("give"))
            back = levels[at - 1].join(out, "node").join(give, ["s", "next"]).groupBy("s", "node").agg(F.sum("give").alias("give"))
            share = durable(levels[at - 1].join(back, ["s", "node"], "left").withColumn("share", F.col("paths") * F.coalesce("give", F.lit(0.0))).drop("give"))
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("score")).limit(0)
    return total.groupBy("node").agg((F.sum("share") * _scale(n)).alias("score"))


def _spread(values: np.ndarray, live: np.ndarray, give: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with an edge from a live one, ascending, and by row of ``values`` the sums that edges bring them; edges are sorted by ``take``."""
    at = np.flatnonzero(live[give])
    if not len(at):
        return at, np.zeros((len(values), 0))
    to = take[at]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    return to[first], np.add.reduceat(values.take(give[at], axis=1), first, axis=1)


def _dependencies(sources: np.ndarray, into: np.ndarray, out: np.ndarray, total: np.ndarray, seen: np.ndarray) -> None:
    """Adds the dependencies of a few sources (Brandes) to ``total``, all sources a level at a time.

    ``into`` and ``out`` are the edges (source, target), sorted by target and by source.
    """
    n, row = len(total), np.arange(len(sources))
    depth, paths = np.full((len(sources), n), -1, np.int32), np.zeros((len(sources), n))
    depth[row, sources], paths[row, sources] = 0, 1
    d = 0
    while (front := depth == d).any():
        to, sums = _spread(np.where(front, paths, 0.0), front.any(0), into[0], into[1])
        fresh = (sums > 0) & (depth[:, to] < 0)
        paths[:, to] += np.where(fresh, sums, 0.0)
        depth[:, to] = np.where(fresh, d + 1, depth[:, to])
        d += 1
    share = np.zeros_like(paths)
    for level in range(d - 1, 0, -1):
        front = depth == level
        to, sums = _spread(np.where(front, (1 + share) / np.where(front, paths, 1.0), 0.0), front.any(0), out[1], out[0])
        share[:, to] += np.where(depth[:, to] == level - 1, paths[:, to] * sums, 0.0)
    reached = depth > 0
    total += np.where(reached, share, 0.0).sum(0)
    seen |= reached.any(0)


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    """The first node, in order of insertion, whose label is or contains ``text``."""
    return nodes.where(F.col("label").contains(text)).orderBy("seq", "id").limit(1)


def ranked(nodes: DataFrame, by: str, k: int = 10) -> DataFrame:
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc(by), "id"))).where(F.col("rank") <= k)


def top_entities(nodes: DataFrame, edges: DataFrame, kind: str, k: int = 10, metric: str = "mention_count") -> DataFrame:
    """(id, label, score, rank) of the k nodes of a type with most mentions, or with most neighbours (``degree``); ties in order of insertion."""
    own = nodes.where(F.col("type") == kind)
    if metric == "degree":
        near = degree(edges).select(F.col("node").alias("_n"), "neighbors")
        own = own.join(near, F.col("id") == F.col("_n"), "left").withColumn("score", F.coalesce("neighbors", F.lit(0)).cast("double"))
    else:
        own = own.withColumn("score", F.coalesce(metric, F.lit(0)).cast("double"))
    best = own.orderBy(F.desc("score"), "seq", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq", "id"))).select("id", "label", "score", "rank")  # k rows


def central_persons(edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(id, label, score, rank): of the k persons that most shortest paths pass, those that any passes."""
    scores = betweenness(edges).withColumnRenamed("node", "_n")
    own = nodes.where("type = 'Person'").join(scores, F.col("id") == F.col("_n"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = own.orderBy(F.desc("score"), "seq", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq", "id"))).where("score > 0").select("id", "label", "score", "rank")  # k rows


def met(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = ("MET_WITH", "AGREED_WITH", "CALLED", "SENT_TO")) -> DataFrame:
    """Who dealt with whom: labels of both ends of person edges, most frequent first."""
    p = nodes.where("type = 'Person'").select("id", "label")
    return edges.where(F.col("type").isin(*types)).join(p.select(F.col("id").alias("source"), F.col("label").alias("who")), "source").join(p.select(F.col("id").alias("target"), F.col("label").alias("whom")), "target").select("who", "whom", "type", "count").orderBy(F.desc("count"), "who", "whom")


def persons_at_locations(edges: DataFrame) -> DataFrame:
    """(person, location): persons with an edge to a location, or actors of an event there; ids, each pair once."""
    to = edges.where(F.col("target").startswith("Location:")).select("source", F.col("target").alias("location"))
    direct = to.where(F.col("source").startswith("Person:")).select(F.col("source").alias("person"), "location")
    there = to.where(F.col("source").startswith("Event:"))
    actors = edges.where("type = 'HAS_ACTOR'").select("source", F.col("target").alias("person")).join(there, "source").select("person", "location")
    return direct.unionByName(actors).distinct()


def persons_at(edges: DataFrame, location: str) -> DataFrame:
    """Persons with an edge to the location, or an actor of an event there."""
    return persons_at_locations(edges.where((F.col("target") == location) | (F.col("type") == "HAS_ACTOR"))).where(F.col("location") == location).select("person").distinct()


def timelines(edges: DataFrame) -> DataFrame:
    """(person, event, locations, times): the events each person acts in, with their places and dates."""
    own = edges.where("type = 'HAS_ACTOR'").select(F.col("source").alias("event"), F.col("target").alias("person")).distinct()
    pick = lambda t: F.array_sort(F.array_compact(F.collect_set(F.when(F.col("type") == t, F.col("target")))))
    told = edges.where(F.col("type").isin("HAS_ACTOR", "OCCURRED_AT", "OCCURRED_ON")).groupBy(F.col("source").alias("event")).agg(pick("OCCURRED_AT").alias("locations"), pick("OCCURRED_ON").alias("times"))
    return own.join(told, "event").select("person", "event", "locations", "times")


def timeline(edges: DataFrame, person: str) -> DataFrame:
    """The person's events with their places and dates."""
    events = edges.where((F.col("type") == "HAS_ACTOR") & (F.col("target") == person)).select("source").distinct()
    return timelines(edges.join(events, "source", "left_semi")).where(F.col("person") == person).select("event", "locations", "times")


def watchlist_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(call_id, keyword, matched_text, note) of calls that match the watchlist."""
    calls, words = nodes.where("type = 'Call'"), nodes.where("type = 'Keyword'")
    e = edges.where("type = 'MATCHES_WATCHLIST'").join(calls.select(F.col("id").alias("source"), F.col("label").alias("call")), "source")
    note = F.col("props")["note"] if "props" in nodes.columns else F.lit(None).cast("string")
    text = F.col("props")["matched_text"] if "props" in edges.columns else F.lit(None).cast("string")
    e = e.withColumn("matched_text", text).select("call", "target", "matched_text")
    return e.join(words.select(F.col("id").alias("target"), F.col("label").alias("keyword"), note.alias("note")), "target").select(F.col("call").alias("call_id"), "keyword", "matched_text", "note")


def speakers_of_term(edges: DataFrame, nodes: DataFrame, term: str) -> DataFrame:
    """Speaker nodes that mentioned the first keyword whose label is or contains ``term``."""
    word = find_node(nodes.where("type = 'Keyword'"), term).select(F.col("id").alias("target"))
    who = edges.where("type = 'MENTIONED'").join(word, "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return nodes.where("type = 'Speaker'").join(who, "id", "left_semi")
