"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Roles of the tables: a conversation is a call and its turns are segments (the
role is the speaker, a character is a unit of time); documents are clips and
texts (source: speaker, lang: dialect); benchmark words are the lexicon and
the watchlist; labels are reviews; embeddings are voice samples (label:
speaker); orders, customers, suppliers and line items are the entity graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans, vectors
from ..functions import text as tx
from ..operators import audio, graph, intervals, kernels, language, records
from ..shared import numbered_in_order, spread
from ..sources import exports, files, stores
from ..streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _millis(c: str):
    """Milliseconds since 1970 of a timestamp without a zone, whatever the session's."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") / 1000)


def segments(spark, d) -> DataFrame:
    s = t(spark, d, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker_id"), "text")
    w = Window.partitionBy("call_id").orderBy("idx")
    end = F.sum(F.length("text")).over(w)
    return s.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def clips(spark, d) -> DataFrame:
    """Documents as clips: 20 characters a second, gender by doc_id, split by source number."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    split = F.when(number % 10 < 8, "train").when(number % 10 == 8, "val").otherwise("test")
    return t(spark, d, "documents").select(
        F.col("doc_id").alias("clip_id"), F.col("source").alias("speaker_id"), F.col("lang").alias("dialect"), F.col("text").alias("transcript"),
        (F.col("n_chars") / 20).alias("duration"), F.when(F.col("doc_id") % 2 == 0, "female").otherwise("male").alias("gender"), split.alias("split"), "n_chars",
    )


def words(spark, d) -> DataFrame:
    return spans.words(t(spark, d, "documents"), "text", "[A-Za-z]+", "doc_id").withColumn("token", F.lower("token"))


def lexicon(spark, d) -> DataFrame:
    """Distinct benchmark words of six letters and more, typed by their length."""
    w = spans.words(t(spark, d, "benchmark"), "text", "[A-Za-z]+", "item_id").select(F.lower("token").alias("term")).where(F.length("term") >= 6).distinct()
    return w.withColumn("type", F.element_at(F.array(F.lit("PERSON"), F.lit("LOCATION"), F.lit("ORGANIZATION")), F.length("term") % 3 + 1))


def hits(spark, d) -> DataFrame:
    return words(spark, d).join(lexicon(spark, d), F.col("token") == F.col("term")).select("doc_id", "pos", "token", "type")


def entity_edges(spark, d) -> DataFrame:
    """Customer to supplier by line item, with the order as the call."""
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "MET_WITH").when(F.col("l_returnflag") == "A", "AGREED_WITH").otherwise("CALLED")
    return j.select(F.concat(F.lit("Person:c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("Person:s"), F.col("l_suppkey").cast("string")).alias("target"), kind.alias("type"), F.col("l_orderkey").alias("call_id"))


SEG = """seg AS (SELECT conv_id AS call_id, turn AS idx, role AS speaker_id, text,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - length(text) AS s
  FROM conversations)"""
CLIPS = """clips AS (SELECT doc_id AS clip_id, source AS speaker_id, lang AS dialect, text AS transcript, n_chars / 20.0 AS duration, n_chars,
  CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
  CASE WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 10 < 8 THEN 'train'
       WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents)"""
WORDS = """w0 AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, lower(unnest(ws)) AS token FROM w0),
l0 AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM benchmark),
lex AS (SELECT DISTINCT lower(term) AS term, CASE length(term) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' ELSE 'ORGANIZATION' END AS type FROM l0 WHERE length(term) >= 6),
hits AS (SELECT doc_id, pos, token, type FROM words JOIN lex ON token = term)"""
EDGES = """raw AS (SELECT 'Person:c' || o_custkey AS source, 'Person:s' || l_suppkey AS target,
  CASE l_returnflag WHEN 'R' THEN 'MET_WITH' WHEN 'A' THEN 'AGREED_WITH' ELSE 'CALLED' END AS type, l_orderkey AS call_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT source, target, type, count(*) AS n FROM raw GROUP BY 1, 2, 3)"""

# Scans, projections, filters


@query(f"WITH {CLIPS} SELECT clip_id, speaker_id, duration FROM clips WHERE length(trim(transcript)) >= 10 AND duration >= 3 AND duration <= 300")
def clip_filter(spark, d):
    return records.usable_clips(clips(spark, d), longest=300.0).select("clip_id", "speaker_id", "duration")


@query("""SELECT doc_id, n_chars < 200 AS quiet, concat_ws(',', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END,
  CASE WHEN text LIKE '%$$$%' THEN 'junk' END) AS issues FROM documents""")
def quality_rules(spark, d):
    rules = [("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 5000), ("junk", F.col("text").contains("$$$"))]
    return audio.with_issues(t(spark, d, "documents"), rules).select("doc_id", (F.col("n_chars") < 200).alias("quiet"), F.concat_ws(",", "issues").alias("issues"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(text, '[!"#$%&''()*+,./:;<=>?@^_`{|}~\[\]\\-]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM benchmark""")
def text_clean(spark, d):
    return t(spark, d, "benchmark").select("item_id", tx.collapse_whitespace(tx.remove_punctuation(F.col("text"))).alias("cleaned"))


@query("SELECT n_nationkey, translate('رقم ٠١٢٣٤٥٦٧٨٩ ' || n_name, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS ascii, translate(CAST(n_nationkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS indic FROM nation")
def digits(spark, d):
    return t(spark, d, "nation").select("n_nationkey", tx.to_ascii_digits(F.concat(F.lit("رقم ٠١٢٣٤٥٦٧٨٩ "), "n_name")).alias("ascii"), tx.to_indic_digits(F.col("n_nationkey").cast("string")).alias("indic"))


@query("SELECT r_regionkey, 'العربية ' || r_name AS plain, translate('أحمد إيمان آمال', 'إأآٱ', 'اااا') AS alef FROM region")
def diacritics_strip(spark, d):
    return t(spark, d, "region").select("r_regionkey", tx.remove_diacritics(F.concat(F.lit("الْعَرَبِيَّةُ "), "r_name")).alias("plain"), tx.normalize_alef(F.lit("أحمد إيمان آمال")).alias("alef"))


@query("SELECT conv_id, turn, 'Speaker:' || role || '_' || conv_id AS node FROM conversations")
def node_ids(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", tx.node_id(F.lit("Speaker"), F.concat("role", F.lit(" "), F.col("conv_id").cast("string"))).alias("node"))


@query(f"""WITH {SEG} SELECT call_id, idx, lpad(CAST(s * 50 // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s * 50 // 60000 % 60 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(s * 50 // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(s * 50 % 1000 AS VARCHAR), 3, '0') AS at FROM seg""")
def srt_times(spark, d):
    return segments(spark, d).select("call_id", "idx", tx.srt_time(F.col("start") * 50 / 1000).alias("at"))


@query("SELECT doc_id, upper(substr(sha256(text), 1, 12)) AS content FROM documents")
def content_ids(spark, d):
    return t(spark, d, "documents").select("doc_id", F.upper(F.substring(tx.content_id(F.col("text").cast("binary")), 3, 12)).alias("content"))


# Aggregates


@query(f"WITH {SEG} SELECT call_id, speaker_id, count(*) AS n_segments, CAST(sum(e - s) AS BIGINT) AS speech, CAST(sum(len(regexp_extract_all(text, '[^\\s]+'))) AS BIGINT) AS n_words, min(idx) AS first_idx FROM seg GROUP BY 1, 2")
def speaker_summary(spark, d):
    n = F.size(F.regexp_extract_all("text", F.lit(r"([^\s]+)"), F.lit(1)))
    return segments(spark, d).groupBy("call_id", "speaker_id").agg(F.count("*").alias("n_segments"), F.sum(F.col("end") - F.col("start")).alias("speech"), F.sum(n).alias("n_words"), F.min("idx").alias("first_idx"))


@query("SELECT count(*) AS total_clips, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM documents")
def manifest_totals(spark, d):
    return records.manifest_totals(clips(spark, d).withColumn("duration", F.col("n_chars"))).withColumnRenamed("total_duration", "total_chars")


@query(f"WITH {CLIPS} SELECT split, count(*) AS n, count(DISTINCT speaker_id) AS speakers, string_agg(DISTINCT dialect, ',' ORDER BY dialect) AS dialects FROM clips GROUP BY 1")
def split_stats(spark, d):
    return records.split_stats(clips(spark, d))


@query(f"WITH {CLIPS} SELECT dialect, count(*) AS n, count(*) FILTER (WHERE gender = 'female') AS female, count(*) FILTER (WHERE gender = 'male') AS male FROM clips GROUP BY 1")
def gender_balance(spark, d):
    return clips(spark, d).groupBy("dialect").agg(F.count("*").alias("n"), F.count_if(F.col("gender") == "female").alias("female"), F.count_if(F.col("gender") == "male").alias("male"))


@query(f"WITH {SEG} SELECT call_id, CAST(sum(length(text) * (idx % 5)) AS DOUBLE) / greatest(1, CAST(sum(length(text)) AS BIGINT)) AS mean_confidence FROM seg GROUP BY 1")
def weighted_confidence(spark, d):
    n = F.length("text")
    return segments(spark, d).groupBy("call_id").agg((F.sum(n * (F.col("idx") % 5)).cast("double") / F.greatest(F.lit(1), F.sum(n))).alias("mean_confidence"))


@query(f"WITH {SEG} SELECT call_id, string_agg(speaker_id || ': ' || text, chr(10) ORDER BY idx) AS full_text FROM seg GROUP BY 1")
def full_text(spark, d):
    return exports._joined(segments(spark, d), F.concat("speaker_id", F.lit(": "), "text"), "\n").withColumnRenamed("value", "full_text")


@query(f"WITH {WORDS} SELECT type, token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM hits GROUP BY 1, 2")
def entity_groups(spark, d):
    return language.entity_totals(hits(spark, d).withColumnRenamed("token", "normalized"), "doc_id").select("type", F.col("normalized").alias("token"), "n", F.col("calls").alias("docs"))


@query(f"WITH {WORDS}, g AS (SELECT substr(token, 1, 4) AS stem, token, count(*) AS n FROM hits GROUP BY 1, 2), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY stem) AS BIGINT) AS mentions, row_number() OVER (PARTITION BY stem ORDER BY length(token) DESC, token DESC) AS k FROM g) SELECT stem, token AS canonical, mentions FROM r WHERE k = 1")
def coref_canonical(spark, d):
    return hits(spark, d).groupBy(F.substring("token", 1, 4).alias("stem")).agg(F.max_by("token", F.struct(F.length("token"), F.col("token"))).alias("canonical"), F.count("*").alias("mentions"))


@query(f"WITH {WORDS}, g AS (SELECT doc_id, token AS stem, count(*) AS n FROM words WHERE length(token) >= 3 AND token NOT IN ('the', 'and', 'der', 'die', 'les', 'que') GROUP BY 1, 2), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, stem) AS rank FROM g) SELECT doc_id, stem, n, total, rank FROM r WHERE rank <= 5")
def keyword_tf(spark, d):
    k = language.keywords(words(spark, d), "doc_id", ["the", "and", "der", "die", "les", "que"], lambda c: c, top=5, by_score=False, places=0)
    return k.select("doc_id", "stem", "n", "total", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {WORDS}, g AS (SELECT doc_id, token || ' ' || lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM words) SELECT doc_id, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def bigrams(spark, d):
    return language.ngrams(words(spark, d), "doc_id", 2, 3)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def status_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {EDGES} SELECT type, count(*) AS n_edges, CAST(sum(n) AS BIGINT) AS weight FROM edges GROUP BY ROLLUP (type)")
def graph_summary(spark, d):
    return graph.upsert_edges(entity_edges(spark, d)).rollup("type").agg(F.count("*").alias("n_edges"), F.sum("count").alias("weight"))


@query("SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS calls, (SELECT count(*) FROM conversations) AS segments, (SELECT count(DISTINCT label) FROM embeddings) AS speakers, (SELECT count(*) FROM documents) AS clips")
def report_summary(spark, d):
    one = lambda name, *a: t(spark, d, name).agg(*a)
    c = one("conversations", F.count_distinct("conv_id").alias("calls"), F.count("*").alias("segments"))
    return c.crossJoin(one("embeddings", F.count_distinct("label").alias("speakers"))).crossJoin(one("documents", F.count("*").alias("clips")))  # one row each


@query("SELECT label AS speaker_id, count(*) AS n_samples, min(vec_id) AS first_sample FROM embeddings GROUP BY 1")
def registry_summary(spark, d):
    return t(spark, d, "embeddings").groupBy(F.col("label").alias("speaker_id")).agg(F.count("*").alias("n_samples"), F.min("vec_id").alias("first_sample"))


@query("SELECT source AS call_id, count(*) AS n_reviews, count(*) FILTER (WHERE toxic = 1) AS rejected FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def review_counts(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("call_id")).agg(F.count("*").alias("n_reviews"), F.count_if(F.col("toxic") == 1).alias("rejected"))


@query(f"""WITH {CLIPS}, a AS (SELECT count(*) AS n, count(DISTINCT speaker_id) AS sp, count(DISTINCT dialect) AS di, count(*) FILTER (WHERE trim(transcript) = '') AS em FROM clips)
SELECT 'clips' AS "check", CASE WHEN n = 0 THEN 'error' ELSE 'ok' END AS level, CAST(n AS DOUBLE) AS value FROM a
UNION ALL SELECT 'speakers', CASE WHEN sp < 4 THEN 'error' ELSE 'ok' END, CAST(sp AS DOUBLE) FROM a
UNION ALL SELECT 'dialects', CASE WHEN di < 2 THEN 'warn' ELSE 'ok' END, CAST(di AS DOUBLE) FROM a
UNION ALL SELECT 'empty_transcripts', CASE WHEN em > 0 THEN 'error' ELSE 'ok' END, CAST(em AS DOUBLE) FROM a""")
def validation_checks(spark, d):
    return records.validation_report(clips(spark, d)).where(F.col("check").isin("clips", "speakers", "dialects", "empty_transcripts"))


# Joins

WORD_SPEAKER = f"""WITH {SEG}, win AS (SELECT call_id, k * 40 AS s, k * 40 + 40 AS e FROM (SELECT call_id, unnest(range(0, CAST(max(e) // 40 + 1 AS BIGINT))) AS k FROM seg GROUP BY call_id)),
o AS (SELECT w.call_id, w.s, g.speaker_id, CASE WHEN g.s IS NOT NULL THEN least(w.e, g.e) - greatest(w.s, g.s) END AS overlap, row_number() OVER (PARTITION BY w.call_id, w.s ORDER BY least(w.e, g.e) - greatest(w.s, g.s) DESC, g.idx) AS k
  FROM win w LEFT JOIN seg g ON w.call_id = g.call_id AND w.s < g.e AND g.s < w.e)
SELECT call_id, s AS start, speaker_id, overlap FROM o WHERE k = 1"""


@query(WORD_SPEAKER)
def word_speaker_overlap(spark, d):
    s = segments(spark, d).withColumnRenamed("idx", "seg")
    w = s.groupBy("call_id").agg(F.max("end").alias("m")).select("call_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 40))).alias("k"))
    w = w.select("call_id", (F.col("k") * 40).alias("start"), (F.col("k") * 40 + 40).alias("end"))
    return intervals.speaker_of_words(w, s).select("call_id", "start", "speaker_id", "overlap")


@query(f"""WITH {SEG} SELECT a.call_id, a.idx, b.idx AS other FROM seg a JOIN seg b ON a.call_id = b.call_id AND a.s - 60 < b.e AND b.s < a.e""")
def overlap_pairs(spark, d):
    s = segments(spark, d).select("call_id", "idx", "start", "end")
    left = s.withColumn("start", F.col("start") - 60)
    return intervals.overlap_join(left, s, "call_id", 500).select("call_id", "idx", F.col("r_idx").alias("other"))


@query(f"""WITH {SEG}, off AS (SELECT call_id, idx, coalesce(CAST(sum(length(text) + 1) OVER (PARTITION BY call_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS lo, length(text) + 1 AS n FROM seg),
ev AS (SELECT call_id, k * 100 AS pos FROM (SELECT call_id, unnest(range(0, CAST(max(lo + n) // 100 + 1 AS BIGINT))) AS k FROM off GROUP BY call_id))
SELECT ev.call_id, ev.pos, off.idx FROM ev LEFT JOIN off ON ev.call_id = off.call_id AND pos >= lo AND pos < lo + n""")
def event_segment(spark, d):
    s = language.character_offsets(segments(spark, d), "call_id", "idx").select("call_id", "idx", "at", "until")
    ev = s.groupBy("call_id").agg(F.max("until").alias("m")).select("call_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 100))).alias("k")).select("call_id", (F.col("k") * 100).alias("pos"))
    return intervals.event_segments(ev, s, "call_id", "pos")


@query(f"WITH {WORDS} SELECT doc_id, pos, token, type FROM hits")
def lexicon_hits(spark, d):
    return hits(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "token", "type")


@query(f"WITH {WORDS}, ids AS (SELECT DISTINCT doc_id, type FROM hits) SELECT ids.doc_id, type, CASE WHEN toxic IS NULL THEN 'pending' WHEN toxic = 1 THEN 'rejected' ELSE 'accepted' END AS review_status FROM ids LEFT JOIN labels ON ids.doc_id = labels.doc_id")
def entities_reviewed(spark, d):
    ents = hits(spark, d).select("doc_id", "type").distinct()
    reviews = t(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").otherwise("accepted").alias("review_status"), F.lit(0).alias("reviewed_at"))
    return records.reviewed(ents, reviews, "doc_id").select("doc_id", "type", "review_status")


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS total_pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars, doc_id LIMIT 50")
def pending_reviews(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars", F.col("n_chars").alias("confidence"))
    return records.pending(docs, t(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "total_pending")


@query("SELECT role AS speaker_id, count(DISTINCT conv_id) AS n_calls, min(conv_id) AS first_call, max(conv_id) AS last_call FROM conversations GROUP BY 1")
def registry_calls(spark, d):
    return t(spark, d, "conversations").groupBy(F.col("role").alias("speaker_id")).agg(F.count_distinct("conv_id").alias("n_calls"), F.min("conv_id").alias("first_call"), F.max("conv_id").alias("last_call"))


@query("SELECT c.conv_id AS call_id, count(*) AS n_segments, count(DISTINCT role) AS n_speakers, max(d.n_chars) AS nlp_chars FROM conversations c LEFT JOIN documents d ON c.conv_id = d.doc_id GROUP BY 1")
def call_summary(spark, d):
    calls = t(spark, d, "conversations").groupBy(F.col("conv_id").alias("call_id")).agg(F.count("*").alias("n_segments"), F.count_distinct("role").alias("n_speakers"))
    return calls.join(t(spark, d, "documents").select(F.col("doc_id").alias("call_id"), F.col("n_chars").alias("nlp_chars")), "call_id", "left")


@query(f"WITH {EDGES} SELECT c.c_name AS who, s.s_name AS whom, type, n FROM edges JOIN customer c ON source = 'Person:c' || c_custkey JOIN supplier s ON target = 'Person:s' || s_suppkey WHERE type IN ('MET_WITH', 'AGREED_WITH')")
def who_met_whom(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("Person:c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"))
    s = t(spark, d, "supplier").select(F.concat(F.lit("Person:s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"))
    nodes = c.unionByName(s).withColumn("type", F.lit("Person"))
    return graph.met(graph.upsert_edges(entity_edges(spark, d)), nodes, ("MET_WITH", "AGREED_WITH")).select("who", "whom", "type", F.col("count").alias("n"))


@query("SELECT DISTINCT c_custkey AS person FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def persons_at_location(spark, d):
    """Customers live in a region; orders of the first priority are events in region 1, their customers the actors."""
    person = lambda c: F.concat(F.lit("Person:"), F.col(c).cast("string"))
    edge = lambda df, source, target, kind: df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))
    lives = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t(spark, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    event = F.concat(F.lit("Event:"), F.col("o_orderkey").cast("string"))
    edges = edge(lives, person("c_custkey"), F.concat(F.lit("Location:"), F.col("n_regionkey").cast("string")), "LIVES_IN")
    edges = edges.unionByName(edge(orders, event, F.lit("Location:1"), "OCCURRED_AT")).unionByName(edge(orders, event, person("o_custkey"), "HAS_ACTOR"))
    return graph.persons_at(edges, "Location:1").select(F.substring_index("person", ":", -1).cast("long").alias("person"))


@query("SELECT o_custkey AS person, o_orderkey AS event, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS places, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def person_timeline(spark, d):
    """Orders are events of their customer; the return flags of their lines are the places."""
    j = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    event = F.concat(F.lit("Event:"), F.col("o_orderkey").cast("string"))
    acts = t(spark, d, "orders").select(event.alias("source"), F.concat(F.lit("Person:"), F.col("o_custkey").cast("string")).alias("target"), F.lit("HAS_ACTOR").alias("type"))
    there = j.select(event.alias("source"), F.concat(F.lit("Location:"), "l_returnflag").alias("target"), F.lit("OCCURRED_AT").alias("type"))
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.count("*").alias("n"))
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    out = graph.timelines(acts.unionByName(there)).select(number("person").alias("person"), number("event").alias("event"), F.array_join(F.transform("locations", lambda x: F.substring_index(x, ":", -1)), ",").alias("places"))
    return out.join(lines, "event").select("person", "event", "places", "n")


@query(f"WITH {EDGES} SELECT source, target, type, n FROM edges WHERE target IN (SELECT 'Person:s' || s_suppkey FROM supplier WHERE s_nationkey < 12) AND source IN (SELECT 'Person:c' || c_custkey FROM customer)")
def edge_integrity(spark, d):
    s = t(spark, d, "supplier").where("s_nationkey < 12").select(F.concat(F.lit("Person:s"), F.col("s_suppkey").cast("string")).alias("id"))
    c = t(spark, d, "customer").select(F.concat(F.lit("Person:c"), F.col("c_custkey").cast("string")).alias("id"))
    return graph.sound_edges(graph.upsert_edges(entity_edges(spark, d)), s.unionByName(c)).select("source", "target", "type", F.col("count").alias("n"))


@query("SELECT source AS speaker_id, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")
def leakage(spark, d):
    return records.leaked_speakers(clips(spark, d).withColumn("split", F.col("clip_id") % 3))


@query("SELECT source AS speaker_id FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def shared_speakers(spark, d):
    c = clips(spark, d)
    of = lambda x: c.where(F.col("dialect") == x).select("speaker_id")
    return of("en").intersect(of("de"))


@query(f"""WITH {WORDS}, f AS (SELECT DISTINCT doc_id, token FROM hits WHERE type = 'PERSON') SELECT a.doc_id, a.token AS subject, b.token AS object FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.token < b.token""")
def triples(spark, d):
    actors = hits(spark, d).where("type = 'PERSON'").groupBy("doc_id").agg(F.array_sort(F.collect_set("token")).alias("actors"))
    ev = actors.select("doc_id", "actors", F.lit("meet").alias("action"), F.array().cast("array<string>").alias("locations"), F.array().cast("array<string>").alias("times"))
    return language.triples(ev, "doc_id").select("doc_id", "subject", "object")


@query("""WITH n AS (SELECT s_name AS label, 'supplier' AS kind, s_suppkey AS id, 1 AS p FROM supplier UNION ALL SELECT c_name, 'customer', c_custkey, 2 FROM customer UNION ALL SELECT n_name, 'nation', n_nationkey, 3 FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p, id) AS k FROM n) SELECT label, kind, CAST(id AS BIGINT) AS id FROM r WHERE k = 1""")
def typed_resolution(spark, d):
    part = lambda name, label, key, p: t(spark, d, name).select(F.col(label).alias("label"), F.lit(name).alias("kind"), F.col(key).cast("long").alias("id"), F.lit(p).alias("p"))
    n = part("supplier", "s_name", "s_suppkey", 1).unionByName(part("customer", "c_name", "c_custkey", 2)).unionByName(part("nation", "n_name", "n_nationkey", 3))
    return n.groupBy("label").agg(F.min_by(F.struct("kind", "id"), F.struct("p", "id")).alias("x")).select("label", "x.*")


# Windows


@query("""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, event_type IN ('click', 'view', 'purchase') AS sp FROM events),
o AS (SELECT user_id, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) - 1 < 2 THEN 0 ELSE 1 END AS brk FROM f WHERE sp),
r AS (SELECT user_id, frame, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM o)
SELECT user_id, min(frame) AS start, max(frame) + 1 AS "end" FROM r GROUP BY user_id, run HAVING max(frame) + 1 - min(frame) >= 3""")
def vad_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    f = t(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("event_type").isin("click", "view", "purchase").alias("speech"))
    return intervals.speech_islands(f, ["user_id"], 3, 2)


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 60 AS e FROM events),
o AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND s - lag(e) OVER w <= 20000 THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT user_id, event_type, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", count(*) AS n FROM r GROUP BY user_id, event_type, run""")
def merge_speaker(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", F.floor(_millis("ts") / 1000).alias("start")).withColumn("end", F.col("start") + 60)
    return intervals.merge_runs(e, ["user_id"], ["event_type"], 20000, ["start", "event_id"]).drop("run")


@query(f"""WITH {SEG}, o AS (SELECT *, CASE WHEN speaker_id = lag(speaker_id) OVER w THEN 0 ELSE 1 END AS brk FROM seg WINDOW w AS (PARTITION BY call_id ORDER BY idx)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY call_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT call_id, speaker_id, min(s) AS start, max(e) AS "end", count(*) AS n, string_agg(text, ' ' ORDER BY idx) AS text FROM r GROUP BY call_id, speaker_id, run""")
def merge_words(spark, d):
    return intervals.merge_runs(segments(spark, d), ["call_id"], ["speaker_id"], 0, ["idx"], "text").drop("run")


@query(f"WITH {SEG} SELECT call_id, idx, coalesce(CAST(sum(length(text) + 1) OVER (PARTITION BY call_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS at FROM seg")
def char_offsets(spark, d):
    return language.character_offsets(segments(spark, d), "call_id", "idx").select("call_id", "idx", "at")


@query(f"WITH {SEG}, f AS (SELECT call_id, idx, speaker_id, min(idx) OVER (PARTITION BY call_id, speaker_id) AS m FROM seg) SELECT call_id, idx, dense_rank() OVER (PARTITION BY call_id ORDER BY m) - 1 AS speaker_slot FROM f")
def speaker_slot(spark, d):
    return exports.speaker_slots(segments(spark, d)).select("call_id", "idx", F.col("speaker_slot").cast("long").alias("speaker_slot"))


@query(f"WITH {WORDS}, g AS (SELECT type, token, count(*) AS n FROM hits GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, token) AS rank FROM g) SELECT type, token, n, rank FROM r WHERE rank <= 10")
def rank_entities(spark, d):
    g = hits(spark, d).groupBy("type", F.col("token").alias("id")).agg(F.count("*").alias("n"))
    return graph.ranked(g, "n", 10).select("type", F.col("id").alias("token"), "n", F.col("rank").cast("long").alias("rank"))


@query("WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id FROM r WHERE k = 1")
def latest_review(spark, d):
    return records.latest(t(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


@query(f"WITH {SEG}, p AS (SELECT call_id, idx, s, e, unnest(range(0, greatest(1, CAST(ceil((e - s) / 100.0) AS BIGINT)))) AS k FROM seg) SELECT call_id, idx, s + k * 100 AS start, least(e, s + k * 100 + 100) AS \"end\" FROM p WHERE least(e, s + k * 100 + 100) - (s + k * 100) >= 30")
def subsegment(spark, d):
    s = segments(spark, d).select("call_id", "idx", "start", "end")
    return intervals.subsegments(s, 100, 30).select("call_id", "idx", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("WITH p AS (SELECT doc_id, n_chars, unnest(range(0, greatest(1, CAST(ceil(n_chars / 300.0) AS BIGINT)))) AS idx FROM documents) SELECT doc_id, idx, idx * 300 AS start, CASE idx % 3 WHEN 0 THEN 'hello' WHEN 1 THEN 'yes' ELSE 'bye' END AS text FROM p")
def mock_asr(spark, d):
    calls = t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("duration"))
    return files.transcribe_mock(calls, "doc_id", ["hello", "yes", "bye"], 300).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), "text")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
r AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT user_id, count(*) AS n, CAST(epoch_us(min(ts)) // 1000 AS BIGINT) AS start_ms FROM r GROUP BY user_id, run""")
def user_sessions(spark, d):
    return live.sessions(t(spark, d, "events").select("user_id", "ts")).select("user_id", "n", _millis("start").alias("start_ms"))


@query("SELECT event_type, CAST(epoch_us(date_trunc('hour', ts)) // 1000 AS BIGINT) AS start_ms, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, d):
    return live.tumbling(t(spark, d, "events")).select("event_type", _millis("start").alias("start_ms"), "n")


# Sets


@query("SELECT doc_id AS clip_id, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS source FROM documents WHERE lang = 'en' OR n_chars > 1000")
def merge_manifests(spark, d):
    docs = t(spark, d, "documents")
    a = docs.where("lang = 'en'").select(F.col("doc_id").alias("clip_id"), F.lit("a").alias("source"))
    return records.merge_manifests([a, docs.where("n_chars > 1000").select(F.col("doc_id").alias("clip_id"), F.lit("b").alias("source"))])


@query("SELECT conv_id AS call_id FROM conversations UNION SELECT doc_id FROM labels UNION SELECT page_id FROM pages")
def call_ids(spark, d):
    one = lambda n, c: t(spark, d, n).select(F.col(c).alias("call_id"))
    return stores.call_ids(one("conversations", "conv_id"), one("labels", "doc_id"), one("pages", "page_id"))


@query(f"WITH {EDGES} SELECT node, CAST(count(*) AS BIGINT) AS degree, count(DISTINCT other) AS neighbors FROM (SELECT source AS node, target AS other FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY 1")
def neighbors(spark, d):
    return graph.degree(graph.upsert_edges(entity_edges(spark, d)))


# Spans


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS email FROM documents")
def emails(spark, d):
    return language.pattern_hits(t(spark, d, "documents"), "doc_id", kinds=("EMAIL",)).select("doc_id", F.col("text").alias("email"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3}[-\s][0-9]{3}[-\s][0-9]{4}')) AS phone FROM documents")
def phones(spark, d):
    hit = spans.find_all(F.col("text"), r"[0-9]{3}[-\s][0-9]{3}[-\s][0-9]{4}")
    return t(spark, d, "documents").select("doc_id", F.explode(F.transform(hit, lambda x: x["text"])).alias("phone"))


@query(r"WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+\s+|\n+')) AS s FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(trim(s))) AS BIGINT) AS chars FROM p WHERE trim(s) <> '' GROUP BY 1")
def sentences(spark, d):
    s = t(spark, d, "documents").select("doc_id", F.explode(spans.sentence_texts(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query(f"WITH {WORDS}, terms AS (SELECT term FROM lex WHERE length(term) >= 9) SELECT doc_id, token AS term, count(*) AS n FROM words JOIN terms ON token = term GROUP BY 1, 2")
def watchlist_hits(spark, d):
    terms = lexicon(spark, d).where(F.length("term") >= 9).select("term", F.lit("").alias("note"))
    lower = t(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return language.watchlist_hits(lower, language.watchlist_terms(terms), "doc_id", pattern="[A-Za-z]+").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"WITH {WORDS} SELECT doc_id, token AS verb, count(*) AS n FROM words WHERE token IN ('is', 'was', 'be', 'are') GROUP BY 1, 2")
def verb_counts(spark, d):
    verbs = spark.createDataFrame([(v, v, "be") for v in ("is", "was", "be", "are")], "form string, verb string, action string")
    lower = t(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return language.verb_hits(lower, verbs, "doc_id", pattern="[A-Za-z]+").groupBy("doc_id", "verb").agg(F.count("*").alias("n"))


# Metrics


def _pairs(spark, d) -> DataFrame:
    """Each benchmark text as the reference of the next one: numbers in order are joined, so no window holds the table."""
    n = numbered_in_order(t(spark, d, "benchmark").select("item_id", F.lower("text").alias("text")), ["item_id"], "n")
    after = n.select((F.col("n") - 1).alias("n"), F.col("text").alias("hyp"))
    return n.withColumnRenamed("text", "ref").join(after, "n", "left").select("item_id", "ref", "hyp")


@query()
def cer_all(spark, d):
    """Character errors of each text against the next. Accents and line breaks count as one character each, which DuckDB's byte-wise levenshtein cannot tell: no SQL."""
    p = _pairs(spark, d)
    return p.where("ref is not null and hyp is not null").select("item_id", F.levenshtein("ref", "hyp").cast("long").alias("distance"))


@query()
def wer_scripts(spark, d):
    """Word errors of each turn against the one before it in its call."""
    prior = F.lag("text").over(Window.partitionBy("call_id").orderBy("idx"))
    p = segments(spark, d).select("call_id", "idx", prior.alias("ref"), F.col("text").alias("hyp")).where("ref is not null")
    e = p.withColumn("e", kernels.word_edits("ref", "hyp"))
    return e.select("call_id", "idx", "e.*").withColumn("wer", kernels.error_rate({c: F.col(c) for c in ("n_ref", "distance")}))


@query(f"WITH {SEG}, g AS (SELECT call_id, idx, speaker_id, unnest(range(s // 10, CAST(ceil(e / 10.0) AS BIGINT))) AS frame FROM seg WHERE e > s), r AS (SELECT call_id, frame, speaker_id, row_number() OVER (PARTITION BY call_id, frame ORDER BY idx DESC) AS k FROM g) SELECT call_id, speaker_id AS label, count(*) AS frames FROM r WHERE k = 1 GROUP BY 1, 2")
def frame_grid(spark, d):
    s = segments(spark, d).select("call_id", F.col("idx").alias("seg"), "start", "end", F.col("speaker_id").alias("label"))
    return intervals.frame_labels(s, ["call_id"], 10).groupBy("call_id", "label").agg(F.count("*").alias("frames"))


@query(f"""WITH {SEG}, fr AS (SELECT call_id, idx, speaker_id, unnest(range(s // 10, CAST(ceil(e / 10.0) AS BIGINT))) AS frame FROM seg WHERE e > s),
ref AS (SELECT call_id, frame, arg_max(speaker_id, idx) AS ref FROM fr GROUP BY 1, 2),
fh AS (SELECT call_id, idx, speaker_id, unnest(range((s + 15) // 10, CAST(ceil((e + 15) / 10.0) AS BIGINT))) AS frame FROM seg WHERE e > s),
hyp AS (SELECT call_id, frame, arg_max(speaker_id, idx) AS hyp FROM fh GROUP BY 1, 2)
SELECT coalesce(ref.call_id, hyp.call_id) AS call_id, count(ref) AS n_ref, count(*) FILTER (WHERE ref IS NOT NULL AND hyp IS NULL) AS miss, count(*) FILTER (WHERE ref IS NULL AND hyp IS NOT NULL) AS false_alarm,
count(*) FILTER (WHERE ref <> hyp) AS confusion FROM ref FULL JOIN hyp ON ref.call_id = hyp.call_id AND ref.frame = hyp.frame GROUP BY 1""")
def der_counts(spark, d):
    s = segments(spark, d).select("call_id", F.col("idx").alias("seg"), "start", "end", F.col("speaker_id").alias("label"))
    late = s.withColumns({"start": F.col("start") + 15, "end": F.col("end") + 15})
    return intervals.frame_errors(intervals.frame_labels(s, ["call_id"], 10), intervals.frame_labels(late, ["call_id"], 10), ["call_id"])


@query()
def der_mapped(spark, d):
    """The best one-to-one mapping of shifted labels to true ones, by call."""
    s = segments(spark, d).select("call_id", F.col("idx").alias("seg"), "start", "end", F.col("speaker_id").alias("label"))
    ref, hyp = (intervals.frame_labels(x, ["call_id"], 10) for x in (s, s.withColumn("label", F.concat(F.lit("x"), "label"))))
    cells = ref.withColumnRenamed("label", "ref").join(hyp.withColumnRenamed("label", "hyp").hint("merge"), ["call_id", "frame"]).groupBy("call_id", "hyp", "ref").agg(F.count("*").alias("n"))
    return kernels.best_mapping(cells, "call_id")


@query("""WITH n AS (SELECT source AS ref, lang AS hyp, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT CAST((SELECT sum(m) FROM (SELECT max(n) AS m FROM n GROUP BY hyp)) AS DOUBLE) / (SELECT count(*) FROM documents) AS purity,
       CAST((SELECT sum(m) FROM (SELECT max(n) AS m FROM n GROUP BY ref)) AS DOUBLE) / (SELECT count(*) FROM documents) AS coverage""")
def purity_coverage(spark, d):
    return intervals.purity_coverage(t(spark, d, "documents").select(F.col("source").alias("ref"), F.col("lang").alias("hyp")), "ref", "hyp")


# Vectors


@query("WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings) SELECT label, dim, CAST(round(avg(CAST(v AS DOUBLE)) * 1000000) AS BIGINT) AS micro FROM x GROUP BY 1, 2")
def centroids(spark, d):
    c = vectors.centroids(t(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round(F.col("x") * 1000000).cast("long").alias("micro"))


@query("WITH x AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings) SELECT vec_id FROM x GROUP BY 1 HAVING sqrt(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) > 0.5")
def valid_embeddings(spark, d):
    return t(spark, d, "embeddings").where(vectors.norm(F.col("embedding")) > 0.5).select("vec_id")


def _registry(spark, d) -> DataFrame:
    return records.voiceprints(t(spark, d, "embeddings").withColumnRenamed("label", "speaker_id"))


@query()
def voiceprint_status(spark, d):
    return _registry(spark, d).select("speaker_id", "n", F.round("agreement", 6).alias("agreement"), "status")


@query()
def identify_top3(spark, d):
    return records.identify(t(spark, d, "embeddings"), _registry(spark, d), "vec_id").select("vec_id", "rank", "speaker_id", F.round("similarity", 6).alias("similarity"), "known")


@query()
def cluster_agglomerative(spark, d):
    e = t(spark, d, "embeddings").withColumn("call", F.floor(F.col("vec_id") / 50))
    return kernels.cluster(e, "call", "vec_id", "embedding", "agglomerative", threshold=0.6)


@query()
def cluster_spectral(spark, d):
    e = t(spark, d, "embeddings").withColumn("call", F.floor(F.col("vec_id") / 50))
    return kernels.cluster(e, "call", "vec_id", "embedding", "spectral")


# Signals


def _customer_signals(spark, d) -> DataFrame:
    """(id, samples): 960 samples of a wave that starts where the key says, the second half silent for every third customer.

    A wave depends on the key's remainders alone; each of the few kinds is made once and given to its customers.
    """
    c = spread(t(spark, d, "customer").select(F.col("c_custkey").alias("id")))
    own = c.select("id", (F.col("id") * 7 % 101).alias("_w"), (F.col("id") % 3 == 0).alias("_q"))
    kinds = spark.range(-100, 101).select(F.col("id").alias("_w"), F.explode(F.array(F.lit(True), F.lit(False))).alias("_q"))
    at = lambda i: F.when(F.col("_q") & (i >= 480), 0.0).otherwise(((F.col("_w") + i * 13) % 101 - 50).cast("double") / 64)
    waves = kinds.select("_w", "_q", F.transform(F.sequence(F.lit(0), F.lit(959)), at).alias("samples"))
    return own.join(F.broadcast(waves), ["_w", "_q"]).select("id", "samples")  # 402 rows


@query("""WITH x AS (SELECT c_custkey AS id, i, CASE WHEN c_custkey % 3 = 0 AND i >= 480 THEN 0.0 ELSE CAST((c_custkey * 7 + i * 13) % 101 - 50 AS DOUBLE) / 64 END AS v FROM customer, (SELECT unnest(range(0, 960)) AS i))
SELECT id, i // 160 AS frame, CAST(round(sqrt(sum(v * v) / 160) * 1000000) AS BIGINT) AS micro_rms FROM x GROUP BY 1, 2""")
def frame_rms(spark, d):
    return audio.frames(_customer_signals(spark, d), "id", 160).select("id", F.col("frame").cast("long").alias("frame"), F.round(F.col("rms") * 1000000).cast("long").alias("micro_rms"))


@query("SELECT o_custkey AS id, CAST(round(CASE WHEN quantile_cont(o_totalprice, 0.95) - quantile_cont(o_totalprice, 0.25) < 10 THEN 100000 ELSE least(quantile_cont(o_totalprice, 0.25) + 6, 100000) END) AS BIGINT) AS level FROM orders GROUP BY 1")
def vad_threshold(spark, d):
    levels = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("db"))
    return audio.voice_thresholds(levels, "id", 10.0, 100000.0, 6.0).select("id", F.round("threshold").cast("long").alias("level"))


@query()
def signal_quality(spark, d):
    """Customers' signals, of two frames each."""
    return audio.quality(_customer_signals(spark, d), "id")


# Graphs


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS c, 's' || l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
b AS (SELECT c AS x, s AS y FROM e UNION ALL SELECT s, c FROM e),
r(node, component) USING KEY (node) AS (SELECT x, x FROM b GROUP BY x UNION SELECT b.x, min(r.component) FROM r JOIN b ON r.node = b.y JOIN recurring.r AS old ON old.node = b.x GROUP BY b.x, old.component HAVING min(r.component) < old.component)
SELECT node, component FROM r""")
def components_all(spark, d):
    """Components over all order-lineitem edges."""
    return graph.components(_purchase_edges(spark, d))


def _purchase_edges(spark, d) -> DataFrame:
    """One edge for each customer and supplier that share a line item."""
    j = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).distinct()


@query()
def betweenness(spark, d):
    e = _purchase_edges(spark, d)
    return graph.betweenness(e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))).select("node", F.round("score", 9).alias("score"))


@query(f"WITH {EDGES} SELECT source AS id, 'Person' AS type, least(10 + 2 * count(*), 40) AS size FROM edges GROUP BY 1")
def graph_demo(spark, d):
    e = graph.upsert_edges(entity_edges(spark, d))
    nodes = e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("mention_count")).select("id", F.lit("Person").alias("type"), F.col("id").alias("label"), "mention_count")
    return exports.graph_demo(nodes, e)[0].select("id", "type", "size")
