"""More registered queries: evaluation, alignment, read models, graph totals and the whole analysis over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans
from ..operators import analysis, audio, evaluation, graph, intervals, kernels, language, records, views
from ..sources import files
from .queries import CLIPS, EDGES, SEG, WORDS, _customer_signals, _purchase_edges, _registry, clips, entity_edges, hits, lexicon, query, segments, t, words

STOP = ["the", "and", "der", "die", "les", "que"]
STOPS = "('the', 'and', 'der', 'die', 'les', 'que')"

# Evaluation


def _labelled(spark, d, shift: int = 0) -> DataFrame:
    s = segments(spark, d)
    return s.select("call_id", F.col("idx").alias("seg"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), F.col("speaker_id").alias("label"))


def _frames(width: int, shift: int, name: str) -> str:
    return f"""{name}0 AS (SELECT call_id, idx, speaker_id, unnest(range((s + {shift}) // {width}, CAST(ceil((e + {shift}) / {width}.0) AS BIGINT))) AS frame FROM seg WHERE e > s),
{name} AS (SELECT call_id, frame, arg_max(speaker_id, idx) AS {name} FROM {name}0 GROUP BY 1, 2)"""


@query(f"""WITH {SEG}, {_frames(10, 0, 'ref')}, {_frames(10, 15, 'hyp')},
bound AS (SELECT call_id, unnest([s // 10, e // 10]) AS b FROM seg), hidden AS (SELECT DISTINCT call_id, unnest(range(greatest(0, b - 2), b + 2)) AS frame FROM bound),
j AS (SELECT coalesce(ref.call_id, hyp.call_id) AS call_id, coalesce(ref.frame, hyp.frame) AS frame, ref, hyp FROM ref FULL JOIN hyp ON ref.call_id = hyp.call_id AND ref.frame = hyp.frame),
k AS (SELECT j.* FROM j WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.call_id = j.call_id AND h.frame = j.frame)),
c AS (SELECT call_id, count(ref) AS n_ref, count(*) FILTER (WHERE ref IS NOT NULL AND hyp IS NULL) AS miss, count(*) FILTER (WHERE ref IS NULL AND hyp IS NOT NULL) AS false_alarm, count(*) FILTER (WHERE ref <> hyp) AS confusion FROM k GROUP BY 1)
SELECT seg.call_id, coalesce(n_ref, 0) AS n_ref, coalesce(miss, 0) AS miss, coalesce(false_alarm, 0) AS false_alarm, coalesce(confusion, 0) AS confusion FROM (SELECT DISTINCT call_id FROM seg) seg LEFT JOIN c ON seg.call_id = c.call_id""")
def der_collar(spark, d):
    """Errors of labels that come 15 characters late, frames of 10, without the frames within 20 of a boundary."""
    return evaluation.diarization_errors(_labelled(spark, d), _labelled(spark, d, 15), "call_id", 10, 20, mapped=False).drop("der")


@query()
def der_full(spark, d):
    """The same with renamed labels, which the best mapping turns back."""
    hyp = _labelled(spark, d, 15).withColumn("label", F.concat(F.lit("x"), "label"))
    return evaluation.diarization_errors(_labelled(spark, d), hyp, "call_id", 10, 20)


@query(f"""WITH {SEG}, {_frames(100, 0, 'ref')}, {_frames(100, 15, 'hyp')}
SELECT ref.call_id, count(*) AS n_total, count(*) FILTER (WHERE ref = hyp) AS n_correct FROM ref LEFT JOIN hyp ON ref.call_id = hyp.call_id AND ref.frame = hyp.frame GROUP BY 1""")
def attribution_accuracy(spark, d):
    return evaluation.attribution(_labelled(spark, d), _labelled(spark, d, 15), "call_id", 100, mapped=False).drop("accuracy")


@query()
def evaluated_calls(spark, d):
    """Each call's text against itself without its first turn; speakers against late ones."""
    s = segments(spark, d)
    ref, hyp = analysis.joined_texts(s).withColumnRenamed("text", "ref"), analysis.joined_texts(s.where("idx > 0")).withColumnRenamed("text", "hyp")
    return evaluation.evaluated(ref.join(hyp, "call_id", "left"), "call_id", _labelled(spark, d), _labelled(spark, d, 15))


# Alignment and totals


@query(f"""WITH {SEG}, late AS (SELECT call_id, idx, speaker_id, s + 15 AS s, e + 15 AS e FROM seg WHERE idx % 3 <> 2),
win AS (SELECT call_id, idx AS seg, s, e, k FROM (SELECT call_id, idx, s, e, unnest(range(0, greatest(1, CAST(ceil((e - s) / 40.0) AS BIGINT)))) AS k FROM seg) WHERE e > s),
w AS (SELECT call_id, seg, k, s + k * 40 AS ws, least(e, s + k * 40 + 40) AS we FROM win),
o AS (SELECT w.*, l.speaker_id AS own, CASE WHEN l.s IS NOT NULL THEN least(we, l.e) - greatest(ws, l.s) END AS ov, row_number() OVER (PARTITION BY w.call_id, w.seg, w.k ORDER BY CASE WHEN l.s IS NOT NULL THEN least(we, l.e) - greatest(ws, l.s) END DESC NULLS LAST, l.idx) AS r FROM w LEFT JOIN late l ON w.call_id = l.call_id AND ws < l.e AND l.s < we),
g AS (SELECT seg.call_id, seg.idx, l.speaker_id AS other, row_number() OVER (PARTITION BY seg.call_id, seg.idx ORDER BY CASE WHEN l.s IS NOT NULL THEN least(seg.e, l.e) - greatest(seg.s, l.s) END DESC NULLS LAST, l.idx) AS r FROM seg LEFT JOIN late l ON seg.call_id = l.call_id AND seg.s < l.e AND l.s < seg.e WHERE seg.e > seg.s)
SELECT o.call_id, o.seg, o.k, CASE WHEN coalesce(ov, 0) / CAST(we - ws AS DOUBLE) >= 0.3 THEN own ELSE other END AS speaker_id FROM o LEFT JOIN g ON o.call_id = g.call_id AND o.seg = g.idx AND g.r = 1 WHERE o.r = 1""")
def words_to_speakers(spark, d):
    """Stretches of 40 characters go to late segments; where they overlap little, their whole turn decides."""
    s = segments(spark, d).withColumnRenamed("idx", "seg").where("end > start")
    w = intervals.subsegments(s.select("call_id", "seg", "start", "end"), 40, 0).withColumnRenamed("piece", "k")
    late = s.where("seg % 3 <> 2").withColumns({"start": F.col("start") + 15, "end": F.col("end") + 15})
    return intervals.aligned_words(w.select("call_id", "seg", "k", "start", "end"), s, late).select("call_id", "seg", F.col("k").cast("long").alias("k"), "speaker_id")


@query(f"""WITH {SEG}, g AS (SELECT call_id, speaker_id, sum(e - s) AS total_speech, count(*) AS n_segments, CAST(sum(len(regexp_extract_all(text, '[^\\s]+'))) AS BIGINT) AS n_words, min(idx) AS f FROM seg GROUP BY 1, 2)
SELECT call_id, speaker_id, CAST(total_speech AS BIGINT) AS total_speech, n_segments, n_words, row_number() OVER (PARTITION BY call_id ORDER BY f) AS rank FROM g""")
def aligned_speakers(spark, d):
    out = intervals.speaker_totals(segments(spark, d))
    return out.select("call_id", "speaker_id", F.col("total_speech").cast("long").alias("total_speech"), "n_segments", "n_words", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SEG}, c AS (SELECT call_id, max(e) AS d FROM seg GROUP BY 1), g AS (SELECT call_id, idx % 2 AS cluster, count(*) AS n_segments, sum(e - s) AS t, arg_min(speaker_id, s) AS speaker_id FROM seg WHERE e > s GROUP BY 1, 2)
SELECT g.call_id, cluster, speaker_id, n_segments, CAST(t AS BIGINT) AS total_speech, CAST(round(CAST(t AS DOUBLE) / d * 10000) AS BIGINT) AS ratio FROM g JOIN c ON g.call_id = c.call_id""")
def diarized_clusters(spark, d):
    s = segments(spark, d)
    calls = s.groupBy("call_id").agg(F.max("end").alias("duration"))
    own = s.where("end > start").withColumns({"cluster": F.col("idx") % 2, "similarity": F.lit(1.0)})
    g = intervals.cluster_totals(own, calls, places=None)  # rounded once, as in the SQL
    return g.select("call_id", "cluster", "speaker_id", "n_segments", F.col("total_speech").cast("long").alias("total_speech"), F.round(F.col("speech_ratio") * 10000).cast("long").alias("ratio"))


@query(f"""WITH {CLIPS}, g AS (SELECT split, count(*) AS n, count(DISTINCT speaker_id) AS speakers, string_agg(DISTINCT dialect, ',' ORDER BY dialect) AS dialects, string_agg(DISTINCT gender, ',' ORDER BY gender) AS genders FROM clips GROUP BY 1)
SELECT split, n, speakers, dialects, genders, CAST(round(1000.0 * n / sum(n) OVER ()) AS BIGINT) AS permille FROM g""")
def split_stats_full(spark, d):
    s = records.split_stats(clips(spark, d), full=True)
    return s.select("split", "n", "speakers", "dialects", "genders", F.round(F.col("percent") * 10).cast("long").alias("permille"))


@query(f"""WITH {CLIPS}, a AS (SELECT count(*) AS n, sum(duration) / 3600 AS h, count(*) FILTER (WHERE gender = 'female') AS f, count(*) FILTER (WHERE gender = 'male') AS m,
  count(*) FILTER (WHERE trim(transcript) <> '' AND len(string_split_regex(trim(transcript), '\\s+')) < 2) AS sh FROM clips),
l AS (SELECT count(*) AS leaks FROM (SELECT speaker_id FROM clips WHERE speaker_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1))
SELECT 'hours' AS "check", CASE WHEN h < 10 THEN 'warn' ELSE 'ok' END AS level FROM a UNION ALL SELECT 'female', CASE WHEN CAST(f AS DOUBLE) / n < 0.2 THEN 'warn' ELSE 'ok' END FROM a
UNION ALL SELECT 'male', CASE WHEN CAST(m AS DOUBLE) / n < 0.2 THEN 'warn' ELSE 'ok' END FROM a UNION ALL SELECT 'short_transcripts', CASE WHEN sh > 0.05 * n THEN 'warn' ELSE 'ok' END FROM a
UNION ALL SELECT 'leakage', CASE WHEN leaks > 0 THEN 'error' ELSE 'ok' END FROM l""")
def validation_rest(spark, d):
    return records.validation_report(clips(spark, d)).where(F.col("check").isin("hours", "female", "male", "short_transcripts", "leakage")).select("check", "level")


# Language


@query(f"""WITH {WORDS}, g AS (SELECT doc_id, token AS stem, count(*) AS n FROM words WHERE length(token) >= 3 AND token NOT IN {STOPS} GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM g), r AS (SELECT doc_id, stem, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, round(n / total * (1 + least(length(stem) / 10.0, 0.5)), 5) DESC, stem) AS rank FROM s WHERE n >= 2)
SELECT doc_id, stem, n, rank FROM r WHERE rank <= 10""")
def keyword_scores(spark, d):
    # texts are dealt once by document, and counts, totals and ranks need no more
    own = spans.words(t(spark, d, "documents").select("doc_id", "text").repartition("doc_id"), "text", "[A-Za-z]+", "doc_id").withColumn("token", F.lower("token"))
    k = language.keywords(own, "doc_id", STOP, lambda c: c, top=10, least_count=2, places=0)
    return k.select("doc_id", "stem", "n", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, token AS a, lead(token) OVER w AS b, lead(token, 2) OVER w AS c FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, a || ' ' || b || ' ' || c AS gram, count(*) AS n FROM p WHERE c IS NOT NULL AND NOT (a IN {STOPS} AND b IN {STOPS} AND c IN {STOPS}) AND greatest(length(a), length(b), length(c)) >= 5 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT doc_id, gram, n, CAST(round(n * length(gram) * 500) AS BIGINT) AS score FROM g""")
def phrase_scores(spark, d):
    g = language.ngrams(words(spark, d), "doc_id", 3, 2, STOP, 5, lambda c: c)
    return g.select("doc_id", "gram", "n", F.round(F.col("score") * 100000).cast("long").alias("score"))


@query(f"WITH {WORDS} SELECT doc_id, type, token AS cluster, token AS canonical, count(*) AS n FROM hits GROUP BY 1, 2, 3")
def entity_clusters(spark, d):
    e = hits(spark, d).select("doc_id", "type", F.col("token").alias("text"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.lit(0.8).alias("confidence"), F.col("token").alias("normalized"))
    return language.entity_clusters(e, "doc_id").select("doc_id", "type", "cluster", "canonical", "n")


@query("""WITH n AS (SELECT DISTINCT p_brand AS brand, lower(p_name) AS name FROM part), w AS (SELECT brand, name, string_split(name, ' ') AS ws FROM n),
s AS (SELECT a.brand, a.name, b.name AS long, len(b.ws) AS k FROM w a JOIN w b ON a.brand = b.brand AND len(a.ws) < len(b.ws) AND list_has_all(b.ws, a.ws))
SELECT brand, name FROM s GROUP BY 1, 2""")
def subnames(spark, d):
    """Part names, and their first words as shorter names, that are part of a longer name of the brand."""
    n = t(spark, d, "part").select(F.col("p_brand").alias("brand"), F.lower("p_name").alias("name")).distinct().withColumn("first", F.lit(0))
    return language.subname_targets(n, "brand").select("brand", "name")


@query(f"WITH {WORDS}, n AS (SELECT DISTINCT doc_id, type, token FROM hits WHERE type = 'PERSON') SELECT token AS actor, count(*) AS n FROM n GROUP BY 1")
def events_by_actor(spark, d):
    ev = hits(spark, d).where("type = 'PERSON'").groupBy("doc_id").agg(F.array_sort(F.collect_set("token")).alias("actors"))
    ev = ev.select("doc_id", "actors", F.lit("meet").alias("action"), F.lit("").alias("sentence"), F.lit(0).alias("sentence_start"))
    return language.events_by_actor(ev, "doc_id").select("actor", "n")


def _verbs(spark) -> DataFrame:
    return spark.createDataFrame([(v, v, a) for v, a in (("is", "be"), ("was", "be"), ("send", "send"), ("call", "call"), ("die", "go"), ("et", "meet"), ("de", "meet"))], "form string, verb string, action string")


def _sure(spark, d) -> DataFrame:
    return lexicon(spark, d).select("term", "type", F.lit(0.8).alias("confidence"), F.lit(1).alias("n_words"))


def _analysed(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The whole analysis of the conversations, with benchmark words as the lexicon and the watchlist."""
    s, lex = segments(spark, d).select("call_id", "idx", "speaker_id", F.lower("text").alias("text")), _sure(spark, d)
    watched = lexicon(spark, d).where(F.length("term") >= 9).select("term", F.lit("").alias("note"))
    return s, analysis.calls_analysed(s, watched, lex, _verbs(spark))


def _documents(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))


@query()
def ner_full(spark, d):
    """Entities of all documents by every rule, with benchmark words as the lexicon."""
    return language.entities(_documents(spark, d), "doc_id", _sure(spark, d))


@query()
def events_full(spark, d):
    """Events of all documents with their entities."""
    docs = _documents(spark, d)
    return language.events(docs, language.entities(docs, "doc_id", _sure(spark, d)), "doc_id", verbs=_verbs(spark))


@query()
def calls_analysed(spark, d):
    return _analysed(spark, d)[1]["metadata"]


@query()
def call_documents(spark, d):
    s, tables = _analysed(spark, d)
    return analysis.documents(s, tables)


@query()
def call_graph(spark, d):
    """The graph of the conversations, built from their analysis."""
    s, tables = _analysed(spark, d)
    return analysis.call_graph(s, tables)[1].select("source", "target", "type", "count", F.size("call_ids").alias("calls"))


@query(r"WITH p AS (SELECT doc_id, text, string_split_regex(text, '[.!?]+\s+|\n+') AS s FROM documents), q AS (SELECT doc_id, unnest(s) AS s FROM p) SELECT doc_id, count(*) AS n FROM q WHERE trim(s) <> '' GROUP BY 1")
def sentence_places(spark, d):
    return spans.sentence_rows(t(spark, d, "documents"), "text", "doc_id").groupBy("doc_id").agg(F.count("start").alias("n"))


# Read models


@query("""WITH s AS (SELECT conv_id AS call_id, count(*) AS n_segments, count(DISTINCT role) AS n_speakers FROM conversations GROUP BY 1), ids AS (SELECT conv_id AS call_id FROM conversations UNION SELECT doc_id FROM labels)
SELECT ids.call_id, CASE WHEN s.call_id IS NULL THEN 'pending' ELSE 'completed' END AS status, coalesce(n_segments, 0) AS n_segments, coalesce(n_speakers, 0) AS n_speakers,
 (SELECT count(*) FROM labels WHERE labels.doc_id = ids.call_id AND toxic = 1) AS watchlist_hits, EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = ids.call_id) AS has_nlp FROM ids LEFT JOIN s ON ids.call_id = s.call_id""")
def call_list(spark, d):
    s, lab = segments(spark, d), t(spark, d, "labels").withColumnRenamed("doc_id", "call_id")
    calls = s.groupBy("call_id").agg(F.max("end").cast("double").alias("duration"))
    ids = s.select("call_id").unionByName(lab.select("call_id"))
    return views.call_summaries(ids, calls, s, lab.where("toxic = 1"), lab).drop("duration")


@query("SELECT label AS speaker_id, count(*) AS n, (SELECT count(DISTINCT source) FROM documents WHERE regexp_extract(source, '([0-9]+)$', 1) = CAST(label AS VARCHAR)) AS n_calls FROM embeddings GROUP BY 1")
def speaker_list(spark, d):
    voices = t(spark, d, "embeddings").groupBy(F.col("label").cast("string").alias("speaker_id")).agg(F.count("*").alias("n"))
    part = t(spark, d, "documents").select(F.regexp_extract("source", r"(\d+)$", 1).alias("speaker_id"), F.col("source").alias("call_id"))
    return views.speaker_rows(voices, part).select(F.col("speaker_id").cast("int").alias("speaker_id"), "n", F.size("participated_in").cast("long").alias("n_calls"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id AS job_id, event_type AS status, event_id AS progress FROM r WHERE k = 1 ORDER BY ts DESC, user_id LIMIT 20""")
def recent_jobs(spark, d):
    log = t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_type").alias("status"), F.col("event_id").alias("progress"))
    return views.recent_jobs(log).select("job_id", "status", "progress")


@query(f"WITH {WORDS} SELECT doc_id || ':wl:' || pos || ':' || token AS id, doc_id AS call_id, token AS matched_text FROM hits WHERE length(token) >= 9")
def watchlist_rows(spark, d):
    h = hits(spark, d).where(F.length("token") >= 9).select(F.col("doc_id").alias("call_id"), F.col("token").alias("term"), F.col("token").alias("text"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return views.watchlist_rows(h).select("id", "call_id", "matched_text")


@query(f"WITH {WORDS} SELECT h.doc_id || ':' || h.type || ':' || h.pos || ':' || (h.pos + 1) AS entity_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'rejected' ELSE 'confirmed' END AS review_status FROM hits h LEFT JOIN labels l ON l.doc_id = h.doc_id AND h.pos % 2 = 0")
def entity_review_rows(spark, d):
    e = hits(spark, d).select(F.col("doc_id").alias("call_id"), "type", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    ident = F.concat_ws(":", F.col("call_id").cast("string"), "type", F.col("start").cast("string"), F.col("end").cast("string"))
    rev = e.where("start % 2 = 0").join(t(spark, d, "labels").withColumnRenamed("doc_id", "call_id"), "call_id").select(ident.alias("entity_id"), F.when(F.col("toxic") == 1, "rejected").otherwise("confirmed").alias("review_status"), F.lit(0).alias("reviewed_at"))
    return views.entity_rows(e, rev).select("entity_id", "review_status")


@query("""WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'warning' ELSE 'ok' END AS status, n_chars FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS duration, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed FROM r""")
def processing_summary(spark, d):
    r = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "warning").otherwise("ok")
    r = r.select(status.alias("status"), F.col("n_chars").alias("duration"), F.col("n_chars").alias("speech"), F.when(F.col("quality") == 0, F.array(F.lit("low quality (by label)"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    s = views.processing_summary(r)
    return s.select("files", "duration", F.coalesce(F.col("by_status")["ok"], F.lit(0)).alias("ok"), F.coalesce(F.col("by_status")["failed"], F.lit(0)).alias("failed"))


# Graphs


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers as persons, nations as places; purchases and homes as edges."""
    e = entity_edges(spark, d).withColumn("seq", F.struct(F.col("call_id").alias("call")))
    c = t(spark, d, "customer").select(F.concat(F.lit("Person:c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Person").alias("type"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k"))
    s = t(spark, d, "supplier").select(F.concat(F.lit("Person:s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("Person").alias("type"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"))
    n = t(spark, d, "nation").select(F.concat(F.lit("Location:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Location").alias("type"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("n"), F.col("n_nationkey").cast("long").alias("k"))
    people = c.unionByName(s)
    nodes = people.unionByName(n).select("id", "type", "label", F.lit(1).alias("mention_count"), F.struct("type", "k").alias("seq"))
    lives = people.select(F.col("id").alias("source"), F.concat(F.lit("Location:"), F.col("n").cast("string")).alias("target"), F.lit("LIVES_IN").alias("type"), F.lit(-1).cast("long").alias("call_id"), F.struct(F.lit(-1).cast("long").alias("call")).alias("seq"))
    return graph.upsert_nodes(nodes), graph.upsert_edges(e.unionByName(lives))


GRAPH = f"""{EDGES}, ppl AS (SELECT 'Person:c' || c_custkey AS id, c_nationkey AS n, c_name AS label FROM customer UNION ALL SELECT 'Person:s' || s_suppkey, s_nationkey, s_name FROM supplier),
nodes AS (SELECT id, 'Person' AS type, label FROM ppl UNION ALL SELECT 'Location:' || n_nationkey, 'Location', n_name FROM nation),
alle AS (SELECT source, target, type FROM edges UNION ALL SELECT id, 'Location:' || n, 'LIVES_IN' FROM ppl)"""


@query(f"WITH {GRAPH}, x AS (SELECT source AS id FROM alle UNION ALL SELECT target FROM alle), c AS (SELECT id, count(*) AS n FROM x GROUP BY 1) SELECT nodes.id, CAST(round(coalesce(c.n, 0) / CAST((SELECT count(*) FROM nodes) - 1 AS DOUBLE) * 1000000) AS BIGINT) AS micro FROM nodes LEFT JOIN c ON nodes.id = c.id")
def degree_centrality(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.degree_centrality(edges, nodes).select("id", F.round(F.col("score") * 1000000).cast("long").alias("micro"))


@query(f"WITH {GRAPH} SELECT 'nodes' AS part, type, count(*) AS n FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'edges', type, count(*) FROM alle GROUP BY ROLLUP (type)")
def graph_totals(spark, d):
    return graph.totals(*_graph(spark, d))


@query(f"WITH {GRAPH}, x AS (SELECT source AS id, target AS o FROM alle UNION ALL SELECT target, source FROM alle), c AS (SELECT id, count(DISTINCT o) AS n FROM x WHERE id LIKE 'Location:%' GROUP BY 1) SELECT c.id, label, CAST(n AS BIGINT) AS score, row_number() OVER (ORDER BY n DESC, CAST(split_part(c.id, ':', 2) AS INT)) AS rank FROM c JOIN nodes ON c.id = nodes.id QUALIFY rank <= 10")
def top_locations(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.top_entities(nodes, edges, "Location", 10, "degree").select("id", "label", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS c, 's' || l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
b AS (SELECT c AS x, s AS y FROM e UNION ALL SELECT s, c FROM e),
r(node, distance) USING KEY (node) AS (SELECT 's1', 0 UNION SELECT b.y, min(r.distance) + 1 FROM r JOIN b ON r.node = b.x LEFT JOIN recurring.r AS old ON old.node = b.y WHERE old.node IS NULL GROUP BY b.y)
SELECT node, CAST(distance AS INT) AS distance FROM r""")
def bfs_all(spark, d):
    """Steps from supplier 1 to every node that can be reached."""
    return graph.distances(_purchase_edges(spark, d), F.col("node") == "s1").select("node", "distance")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey), p AS (SELECT e1.s FROM e e1 JOIN e e2 ON e1.c = e2.c WHERE e1.s = 1 AND e2.s = 2 LIMIT 1)
SELECT 3 AS n, 's1' AS first, 's2' AS last FROM p""")
def path_length(spark, d):
    """Nodes on a shortest path between two suppliers, which share a customer."""
    path = graph.shortest_path(_purchase_edges(spark, d), "s1", "s2") or []
    return spark.createDataFrame([(len(path), path[0], path[-1])] if path else [], "n int, first string, last string")


@query(f"WITH {GRAPH} SELECT count(*) AS size, 1 AS rank FROM nodes")
def communities(spark, d):
    """Purchases and homes join everyone; the one community is the whole graph."""
    nodes, edges = _graph(spark, d)
    return graph.communities(edges, nodes).select("size", "rank").where("rank = 1")


@query()
def central_persons(spark, d):
    """Persons that most shortest paths pass, over purchases both ways."""
    e = _purchase_edges(spark, d)
    nodes = graph.both_ways(e).select(F.col("node").alias("id")).distinct().select("id", F.lit("Person").alias("type"), F.col("id").alias("label"), F.lit(1).alias("mention_count"), F.struct("id").alias("seq"))
    return graph.central_persons(e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))), nodes).select("rank", "label", F.round("score", 9).alias("score"))


# Vectors and signals


@query("""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) >= 0.8""")
def similar_pairs(spark, d):
    return records.similarities(t(spark, d, "embeddings"), "vec_id", "embedding", 0.8).select("a", "b")


@query("""WITH x AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT label, dim, avg(v) AS v FROM x GROUP BY 1, 2),
cn AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY 1), xn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1),
s AS (SELECT x.vec_id, c.label, sum(x.v * c.v) AS s FROM x JOIN c ON x.dim = c.dim GROUP BY 1, 2), r AS (SELECT s.vec_id, s.label, s.s / (cn.n * xn.n) AS s FROM s JOIN cn ON s.label = cn.label JOIN xn ON s.vec_id = xn.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rank FROM r) SELECT vec_id, rank, label AS speaker_id FROM k WHERE rank <= 3""")
def identified(spark, d):
    return records.identify(t(spark, d, "embeddings"), _registry(spark, d), "vec_id").select("vec_id", F.col("rank").cast("long").alias("rank"), "speaker_id")


@query()
def auto_registered(spark, d):
    """Labels' first vectors of each hundred, call by call, against a registry that starts empty."""
    e = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("string").alias("call_id"), F.col("label").cast("long").alias("cluster"), "vec_id", "embedding")
    c = e.groupBy("call_id", "cluster").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    empty = spark.createDataFrame([], "speaker_id string, centroid array<double>, n long")
    return records.auto_registered(empty, c, 0.6)[0]


@query()
def speech_segments(spark, d):
    """Speech in customers' signals at 1,000 samples a second."""
    return audio.speech_segments(_customer_signals(spark, d), "id", rate=1000, least_speech_ms=90, least_silence_ms=60)


@query()
def embedded_segments(spark, d):
    """Voiceprints of made audio's speech."""
    s = files.made_audio(spark)
    pieces = audio.speech_segments(s, "id")
    return audio.embedded(s, pieces, "id").select("id", "seg", F.size("embedding").alias("n"))


@query()
def audio_reports(spark, d):
    return audio.reports(files.made_audio(spark).drop("shape"), "id").select("id", "duration", "speech_ratio", "status", "warnings")


@query()
def cluster_sizes(spark, d):
    """Clusters of each fifty vectors, with those under three members joined to others."""
    e = t(spark, d, "embeddings").withColumn("call", F.floor(F.col("vec_id") / 50))
    return kernels.cluster(e, "call", "vec_id", "embedding", "agglomerative", threshold=0.6, least=3).groupBy("call", "cluster").agg(F.count("*").alias("n"))


@query()
def made_calls(spark, d):
    """As many made calls as there are conversations, with their mock words."""
    n = t(spark, d, "conversations").select("conv_id").distinct().count()
    made = files.made_calls(spark, n)
    words_ = files.mock_words(made, "call_id")
    w = Window.partitionBy("call_id", "seg")
    return words_.withColumn("n", F.count("*").over(w)).groupBy("call_id").agg(F.count("*").alias("n_words"), F.max("end").alias("end"))
