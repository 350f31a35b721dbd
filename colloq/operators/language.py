"""Rule-based language operators: entities, coreference, keywords, watchlists, events, triples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons, spans
from ..functions import text as tx

ARABIC_RUN = "[؀-ۿ]+|[A-Za-z0-9_]+"
WORD_RUN = r"[\p{L}\p{N}_]+"


def lexicon(spark: SparkSession) -> DataFrame:
    """(term, type, confidence, n_words): a fixed list of a few hundred rows."""
    return spark.createDataFrame(lexicons.terms(), "term string, type string, confidence double, n_words int")


def lexicon_hits(df: DataFrame, lex: DataFrame, key: str, text: str = "text", pattern: str = ARABIC_RUN, most_words: int = 2) -> DataFrame:
    """(key, type, text, start, end, confidence) of whole-token matches; one hash join stands for a regex per term.

    Tokens hold no spaces: a term is found by its first word, and those of
    several words are then compared with the neighbouring tokens.
    """
    t = spans.tokens(df, text, pattern, key, ahead=most_words - 1)
    terms = lex.select(F.split("term", " ")[0].alias("_first"), F.col("term").alias("_term"), F.col("n_words").alias("_n"), "type", "confidence")
    gram, end = F.col("token"), F.col("end")
    for n in range(2, most_words + 1):
        words = F.when(F.col(f"token_{n - 1}").isNotNull(), F.concat_ws(" ", "token", *[f"token_{i}" for i in range(1, n)]))
        gram, end = F.when(F.col("_n") == n, words).otherwise(gram), F.when(F.col("_n") == n, F.col(f"end_{n - 1}")).otherwise(end)
    found = t.join(terms, (t["token"] == terms["_first"]) & F.col("_n").between(1, most_words)).where(gram == F.col("_term"))
    return found.select(key, "type", F.col("_term").alias("text"), "start", end.alias("end"), "confidence")


def _needs(pattern: str) -> str:
    """What a text with a match of this rule must hold: an Arabic letter if one is left when optional groups are out, else an at sign or a digit (no rule has other ways around them)."""
    must = re.sub(r"\(\?:[^()]*\)\?", "", pattern)
    return "[؀-ۿ]" if re.search("[؀-ۿ]", must) else "@" if "@" in must else r"\p{Nd}"


def pattern_hits(df: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(key, type, text, start, end, confidence) of the pattern rules; a rule passes over texts that lack what it needs."""
    def typed(kind: str, confidence: float, pattern: str) -> Column:
        row = lambda x: F.struct(F.lit(kind).alias("type"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), F.lit(confidence).alias("confidence"))
        return F.transform(spans.find_all(F.col("_t"), pattern), row)

    rules = [rule for rule in lexicons.PATTERNS if kinds is None or rule[0] in kinds]
    needs = sorted({_needs(rule[2]) for rule in rules})
    none = F.array().cast("array<struct<type:string,text:string,start:int,end:int,confidence:double>>")
    found = [F.when(F.col(f"_has_{needs.index(_needs(rule[2]))}"), typed(*rule)).otherwise(none) for rule in rules]
    own = df.select(key, F.col(text).alias("_t"), *[F.col(text).rlike(x).alias(f"_has_{i}") for i, x in enumerate(needs)])
    return own.select(key, F.inline(F.flatten(F.array(*found))))


def normalized(kind: Column, text: Column) -> Column:
    """The form of an entity that names its node."""
    return (
        F.when(kind == "EMAIL", F.lower(text)).when(kind == "PHONE", F.regexp_replace(text, r"(?U)[\s-]", "")).when(kind == "MONEY", tx.strip_space(text))
        .when(kind.isin("DATE", "TIME"), tx.remove_diacritics(text)).otherwise(tx.strip_space(tx.squeezed(text)))
    )


def resolver_key(kind: Column, text: Column, fallback: Column) -> Column:
    """The form under which mentions are one entity; honorifics and the article of a place do not count."""
    name = F.when(kind == "PERSON", tx.normalize_person(text)).when(kind == "LOCATION", tx.normalize_location(text)).when(kind == "ORGANIZATION", tx.normalize_organization(text)).otherwise(F.lower(text))
    return F.coalesce(F.when(name != "", name), F.when(fallback != "", fallback), text)


_SPAN = "array<struct<type:string,text:string,start:int,end:int,confidence:double,source:string>>"


def _span(kind: str, text: Column, start: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), F.lit(confidence).alias("confidence"), F.lit("rule").alias("source"))


def organization_spans(text: Column) -> Column:
    """Array of names that begin with a head word: the first of each head, to the end of the text, if that is five words at most."""
    out = []
    for head in lexicons.ORGANIZATION_HEADS:
        pattern = rf"(?U){head}\s+\S+(?:\s+\S+)*"
        found = F.regexp_extract(text, pattern, 0)
        short = (found != "") & (F.size(F.split(found, r"(?U)\s+")) <= 5)
        out.append(F.when(short, F.array(_span("ORGANIZATION", found, F.regexp_instr(text, F.lit(pattern)) - 1, 0.70))).otherwise(F.array().cast(_SPAN)))
    hospital = F.transform(spans.find_all(text, rf"(?U){lexicons.HOSPITAL}\s+\S+"), lambda x: _span("ORGANIZATION", x["text"], x["start"], 0.70))
    return F.concat(*out, hospital)


#: Code points in a piece of a text, so that the surroundings of a span are found without reading the text from its start.
PIECE = 256


def _near(text: Column, pieces: Column):
    """A span with what lies around it: ``off``, and ``near``, the text from there to a piece or more beyond the span's end.

    White space and a word that go on beyond that are followed to the end of the text.
    """

    def look(s):
        first = F.floor(F.greatest(F.lit(0), s["start"] - 15) / PIECE).cast("int")
        own = F.struct((first * PIECE).alias("off"), F.array_join(F.slice(pieces, first + 1, F.floor(s["end"] / PIECE).cast("int") + 2 - first), "").alias("near"))

        def whole(o):
            here = s["end"] - o["off"]
            cut = F.substring(o["near"], here + 1, F.length(o["near"])).rlike(r"(?U)^\s+\S*$") & (s["type"] == "PERSON") & (s["source"] == "dictionary")
            return F.struct(*[s[c].alias(c) for c in ("type", "text", "start", "end", "confidence", "source")], o["off"].alias("off"), F.when(cut, F.substring(text, o["off"] + 1, F.length(text))).otherwise(o["near"]).alias("near"))

        return F.transform(F.array(own), whole)[0]

    return look


def _refined(found: DataFrame, keep: list[str], names: list[str], indicators: list[str]) -> DataFrame:
    """Spans as their surroundings have them: a name takes a following name, a place after an indicator is surer, a kunya ends before punctuation."""
    at, near = F.col("start") - F.col("off"), F.col("near")
    tail = F.substring(near, F.col("end") - F.col("off") + 1, F.length(near))
    own = found.withColumn("_after", F.regexp_extract(tail, r"(?U)^\s+\S+", 0))
    word = F.regexp_replace(F.regexp_replace("_after", r"(?U)^\s+", ""), "^[.,؛،]+|[.,؛،]+$", "")
    person, dictionary = F.col("type") == "PERSON", F.col("source") == "dictionary"
    before = tx.strip_space(F.substring(near, F.greatest(F.lit(1), at - 4), F.least(F.lit(5), F.col("start"))))
    told = F.lit(False)
    for word_ in indicators:
        told = told | before.endswith(word_)
    content = F.when(person & dictionary & word.isin(names), F.concat("text", "_after")).when(person & ~dictionary, F.regexp_replace("text", "[.,؛،!?؟]+$", "")).otherwise(F.col("text"))
    sure = F.when((F.col("type") == "LOCATION") & dictionary & told, F.greatest("confidence", F.lit(0.90))).otherwise(F.col("confidence"))
    own = own.select(*keep, "type", content.alias("text"), "start", sure.alias("confidence"), "source", at.alias("_at"), "near")
    end = F.col("_at") + F.length("text")
    return own.select(*keep, (-F.length("text")).alias("neg"), (-F.col("confidence")).alias("nc"), "start", (F.col("start") + F.length("text")).alias("end"), "type", "text", "confidence", "source", spans.context(near, F.col("_at"), end).alias("context"))


def entities(df: DataFrame, key: str, lex: DataFrame | None = None, text: str = "text", names: list[str] | None = None, indicators: list[str] | None = None) -> DataFrame:
    """(key, type, text, start, end, confidence, source, context, normalized): all rules together.

    Of overlapping spans the longest, then surest, then first stays. ``names``
    may follow a person's name, ``indicators`` stand before places. Days,
    months and organisations are matched as whole words, persons and places as
    whole runs of the Arabic block, as the lexicon's types say.
    """
    lex = lex if lex is not None else F.broadcast(lexicon(df.sparkSession))
    names = lexicons.FAMILY_NAMES + lexicons.FIRST_NAMES if names is None else names
    indicators = lexicons.LOCATION_INDICATORS if indicators is None else indicators
    runs, words = lex.where(F.col("type").isin("PERSON", "LOCATION")), lex.where(~F.col("type").isin("PERSON", "LOCATION"))
    listed = lexicon_hits(df, runs, key, text).unionByName(lexicon_hits(df, words, key, text, WORD_RUN, 2)).withColumn("source", F.lit("dictionary"))
    places = df.where(F.col(text).rlike("[؀-ۿ]")).select(key, F.inline(organization_spans(F.col(text))))  # the heads are Arabic words
    every = listed.unionByName(pattern_hits(df, key, text).withColumn("source", F.lit("rule"))).unionByName(places)
    found = every.groupBy(key).agg(F.collect_list(F.struct("type", "text", "start", "end", "confidence", "source")).alias("_s"))
    cut = df.select(key, F.col(text).alias("_t")).join(found, key).withColumns({"_p": F.regexp_extract_all("_t", F.lit(rf"(?s)(.{{1,{PIECE}}})"), F.lit(1)), "_row": F.monotonically_increasing_id()})
    own = cut.select(key, "_row", F.inline(F.transform("_s", _near(F.col("_t"), F.col("_p")))))
    kept = spans.disjoint_rows(_refined(own, [key, "_row"], names, indicators), [key, "_row"], ["neg", "nc", "start", "end", "type", "text", "confidence", "source", "context"])
    return kept.select(key, "start", "end", "type", "text", "confidence", "source", "context").withColumn("normalized", normalized(F.col("type"), F.col("text")))


def entity_totals(ents: DataFrame, key: str) -> DataFrame:
    """(type, normalized, n, calls): how often each entity is named, and in how many calls."""
    return ents.groupBy("type", "normalized").agg(F.count("*").alias("n"), F.count_distinct(key).alias("calls"))


def merged_duplicates(ents: DataFrame, key: str) -> DataFrame:
    """(key, type, normalized, n, confidence, mentions): one row for each name of a type, most frequent first in ``rank``."""
    g = ents.groupBy(key, "type", "normalized").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"), F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("mentions"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "type", "normalized")))


def subname_targets(names: DataFrame, key: str) -> DataFrame:
    """(key, name, root) for names (key, name, first) whose words all occur in a longer name of the key.

    A name goes to the first such name in order of word count, then of first
    mention, and on to where that one goes. Candidates share a word (an equi
    join on the shorter name's least word), so no pairs of unlike names arise.
    Pointers are doubled five times: chains of up to 32 ever longer names.
    """
    words = F.split("name", " ")
    a = names.select(F.col(key).alias("_k"), F.col("name").alias("_short"), words.alias("_sw"), F.array_min(words).alias("_w"))
    b = names.select(F.col(key).alias("_k"), F.col("name").alias("_long"), words.alias("_lw"), F.col("first").alias("_at"), F.explode(F.array_distinct(words)).alias("_w"))
    inside = a.join(b, ["_k", "_w"]).where((F.size("_sw") < F.size("_lw")) & (F.size(F.array_except("_sw", "_lw")) == 0))
    up = inside.groupBy("_k", "_short").agg(F.min_by("_long", F.struct(F.size("_lw"), F.col("_at"), F.col("_long"))).alias("_to"))
    for _ in range(5):
        on = up.select("_k", F.col("_short").alias("_to"), F.col("_to").alias("_next"))
        up = up.join(on, ["_k", "_to"], "left").select("_k", "_short", F.coalesce("_next", "_to").alias("_to"))
    return up.select(F.col("_k").alias(key), F.col("_short").alias("name"), F.col("_to").alias("root"))


def entity_clusters(ents: DataFrame, key: str, subnames: bool = True) -> DataFrame:
    """Coreference: (key, type, cluster, canonical, n, confidence, mentions, rank).

    Mentions of one type are one entity if their resolver forms agree, or, for
    persons, if one form is part of the other. The longest, then surest, then
    first text is the name.
    """
    e = ents.withColumn("_c", resolver_key(F.col("type"), F.col("text"), F.col("normalized")))
    if subnames:
        people = e.where("type = 'PERSON'").groupBy(key, F.col("_c").alias("name")).agg(F.min("start").alias("first"))
        up = subname_targets(people, key).select(F.col(key).alias("_k"), F.col("name").alias("_n"), "root")
        e = e.join(up, (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("_c") == F.col("_n")) & (F.col("type") == "PERSON"), "left").withColumn("_c", F.coalesce("root", "_c")).drop("_k", "_n", "root")
    g = e.groupBy(key, "type", F.col("_c").alias("cluster")).agg(
        F.max_by("text", F.struct(F.length("text"), F.col("confidence"), (-F.col("start")).alias("s"))).alias("canonical"), F.count("*").alias("n"), F.avg("confidence").alias("confidence"),
        F.min("start").alias("_first"), F.array_sort(F.collect_list(F.struct("start", "end", "text", "confidence"))).alias("mentions"),
    )
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "_first", "type", "cluster"))).drop("_first")


def global_clusters(ents: DataFrame, subnames: bool = True) -> DataFrame:
    """(canonical, type, cluster, n, confidence, calls) over all calls: entity_clusters without the call; calls are counted."""
    e = ents.withColumn("_all", F.lit(0))
    return entity_clusters(e, "_all", subnames).drop("_all", "mentions", "rank")


def entity_groups(ents: DataFrame, key: str) -> DataFrame:
    """One row per (key, type, normalised form) with the longest, then surest, text as its name."""
    return ents.groupBy(key, "type", "normalized").agg(
        F.max_by("text", F.struct(F.length("text"), F.col("confidence"), (-F.col("start")).alias("s"))).alias("canonical"), F.count("*").alias("n"), F.avg("confidence").alias("confidence"),
        F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("mentions"),
    )


def keywords(toks: DataFrame, key: str, stop: list[str], stem, top: int | None = 20, least_chars: int = 3, least_count: int = 1, least_stem: int = 1, by_score: bool = True, places: int = 10) -> DataFrame:
    """(key, stem, word, n, total, score, positions, rank) by stem: the shortest surface form, the first ``places`` places.

    The score is the share of the kept words, raised by up to a half for long
    words. ``places`` of 0 leaves the positions out; otherwise they are ranked
    before they are gathered, so a frequent stem holds no long list. Ranks go
    by count, then score (or only by count), then word.
    """
    at = "start" if "start" in toks.columns else "pos"
    t = toks.where((F.length("token") >= least_chars) & ~F.col("token").isin(stop)).withColumn("stem", stem(F.col("token")))
    t = t.where((F.length("stem") >= least_stem) & ~F.col("stem").isin(stop))
    aggs = [F.count("*").alias("n"), F.min_by("token", F.struct(F.length("token"), F.col("pos"))).alias("word")]
    if places:
        t = t.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "stem").orderBy(at)))
        aggs.append(F.sort_array(F.collect_list(F.when(F.col("_nth") <= places, F.col(at)))).alias("positions"))
    g = t.groupBy(key, "stem").agg(*aggs)
    g = g.withColumn("total", F.sum("n").over(Window.partitionBy(key))).where(F.col("n") >= least_count)
    g = g.withColumn("score", F.round(F.col("n") / F.col("total") * (1 + F.least(F.length("word") / 10, F.lit(0.5))), 5))
    order = [F.desc("n"), F.desc("score"), F.col("word"), F.col("stem")] if by_score else [F.desc("n"), F.col("stem")]
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def ngrams(toks: DataFrame, key: str, n: int = 2, least: int = 2, stop: list[str] | None = None, least_chars: int = 0, stem=None) -> DataFrame:
    """(key, gram, n) of neighbouring tokens that occur at least ``least`` times, with score and stem if ``stem`` is given.

    Grams of stop words alone, and those without a word of ``least_chars``, do not count.
    """
    w = Window.partitionBy(key).orderBy("pos")
    words = [F.col("token") if i == 0 else F.lead("token", i).over(w) for i in range(n)]
    g = toks.select(key, F.array(*words).alias("g")).where(~F.array_contains(F.transform("g", lambda x: x.isNull()), True))
    if stop:
        g = g.where(F.exists("g", lambda x: ~x.isin(stop)))
    if least_chars:
        g = g.where(F.exists("g", lambda x: F.length(x) >= least_chars))
    out = g.groupBy(key, F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if stem is None:
        return out
    return out.withColumns({"score": F.round(F.col("n") * 0.05 * F.length("gram") / 10, 5), "stem": F.array_join(F.transform(F.split("gram", " "), stem), " ")})


def key_phrases(df: DataFrame, key: str, text: str = "text", top: int = 20, most_words: int = 1, stop: list[str] | None = None) -> DataFrame:
    """Arabic keywords of each text, and its phrases of up to ``most_words``, by count, score and text: (key, text, stem, n, score, rank)."""
    stop = lexicons.STOPWORDS if stop is None else stop
    toks = spans.tokens(df.select(key, tx.clean_text(F.col(text)).alias("_t")), "_t", "[؀-ۿ]+", key)
    out = keywords(toks, key, stop, tx.light_stem, top=None, least_stem=2, places=0).select(key, F.col("word").alias("text"), "stem", "n", "score")
    for n in range(2, most_words + 1):
        out = out.unionByName(ngrams(toks, key, n, 2, stop, 3, tx.light_stem).select(key, F.col("gram").alias("text"), "stem", "n", "score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.desc("score"), "text"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


def watchlist_terms(terms: DataFrame) -> DataFrame:
    """(term, variant): the term, without diacritics, with one alef, with one yaa; blank and repeated terms go."""
    t = terms.select(F.trim("term").alias("term"), "note").where("term <> ''").dropDuplicates(["term"])
    plain = tx.remove_diacritics(F.col("term"))
    return t.withColumn("variant", F.explode(F.array_distinct(F.array("term", plain, tx.normalize_alef(plain), tx.normalize_yaa(tx.normalize_alef(plain))))))


def watchlist_hits(df: DataFrame, variants: DataFrame, key: str, text: str = "text", pattern: str = ARABIC_RUN, most_words: int = 4) -> DataFrame:
    """(key, term, text, start, end): from left to right the longest match, then none that overlaps it."""
    lex = variants.select(F.col("variant").alias("term"), F.col("term").alias("type"), F.lit(1.0).alias("confidence"), F.size(F.split("variant", " ")).alias("n_words"))
    hits = lexicon_hits(df, lex, key, text, pattern, most_words)
    rows = hits.select(key, "start", (-F.col("end")).alias("neg"), "end", F.col("type").alias("term"), "text")
    return spans.disjoint_rows(rows, [key], ["start", "neg", "end", "term", "text"]).drop("neg")


def verb_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(p + v, v, a) for v, a in lexicons.verbs().items() for p in lexicons.VERB_PREFIXES]
    return spark.createDataFrame(rows, "form string, verb string, action string").groupBy("form").agg(F.max_by(F.struct("verb", "action"), F.length("verb")).alias("v")).select("form", "v.*")


def verb_hits(df: DataFrame, verbs: DataFrame, key: str, text: str = "text", pattern: str = ARABIC_RUN) -> DataFrame:
    """(key, start, end, verb, action); the forms of a language's verbs are few and go to every task."""
    t = spans.tokens(df, text, pattern, key)
    return t.join(F.broadcast(verbs), t["token"] == verbs["form"]).select(key, "start", (F.col("start") + F.length("verb")).alias("end"), "verb", "action")


def objects_after(sentence: Column, at: Column) -> Column:
    """Up to four Arabic words after the verb, before a preposition or punctuation."""
    head = F.split(F.substring(sentence, at + 1, F.length(sentence)), r"\s+(?:" + "|".join(lexicons.OBJECT_STOPS) + r")\s+|[،,.;:]", 2)[0]
    words = F.transform(F.slice(F.split(F.trim(head), r"\s+"), 2, 4), lambda w: F.regexp_replace(w, "^[.,؛،\"']+|[.,؛،\"']+$", ""))
    good = lambda w: w.rlike("^[؀-ۿ]{3,}$")
    step = lambda acc, w: F.when(acc["open"] & good(w), F.struct(F.lit(True).alias("open"), F.array_append(acc["out"], w).alias("out"))).otherwise(F.struct(F.lit(False).alias("open"), acc["out"].alias("out")))
    return F.aggregate(words, F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])


def watchlist_line_hits(lines: DataFrame, variants: DataFrame, key: str, line: str = "line_index", text: str = "text") -> DataFrame:
    """watchlist_hits of rows (key, line, text), each line scanned alone: (key, line, term, text, start, end)."""
    own = lines.withColumn("_l", F.struct(key, line))
    return watchlist_hits(own, variants, "_l", text).select(F.col(f"_l.{key}").alias(key), F.col(f"_l.{line}").alias(line), "term", "text", "start", "end")


def events(df: DataFrame, ents: DataFrame, key: str, text: str = "text", verbs: DataFrame | None = None, least_actors: int = 0) -> DataFrame:
    """One row per verb: its sentence, action, and the entities that begin in that sentence."""
    verbs = verbs if verbs is not None else verb_lexicon(df.sparkSession)
    s = spans.sentence_rows(df, text, key).withColumnRenamed("start", "sentence_start")
    # a sentence goes with its verbs, so that it need not be joined to them
    v = verb_hits(s.select(F.struct(key, "sentence_start", "sentence").alias("_sid"), F.col("sentence").alias("_s")), verbs, "_sid", "_s")
    v = v.select("_sid.*", F.col("start").alias("verb_at"), "verb", "action")
    e = ents.select(F.col(key).alias("_k"), F.col("start").alias("_at"), F.col("type").alias("_type"), F.col("normalized").alias("_name"))
    told = s.select(F.col(key).alias("_k"), F.col("sentence_start").alias("_at"), F.struct(F.col("sentence_start").alias("start"), (F.col("sentence_start") + F.length("sentence")).alias("end")).alias("_in"))
    # sentences lie one after another: the last one that begins at or before an entity holds it, or none does
    both = e.withColumn("_in", F.lit(None).cast(told.schema["_in"].dataType)).unionByName(told, allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_at", F.col("_type").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_in", F.last("_in", ignorenulls=True).over(w)).where(F.col("_type").isNotNull() & (F.col("_at") < F.col("_in.end")))
    pick = lambda *kinds: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("_type").isin(*kinds), F.col("_name")))))
    by = held.groupBy("_k", F.col("_in.start").alias("_start")).agg(pick("PERSON").alias("actors"), pick("LOCATION").alias("locations"), pick("DATE", "TIME").alias("times"))
    out = v.join(by, (F.col(key) == F.col("_k")) & (F.col("sentence_start") == F.col("_start")), "left").drop("_k", "_start")
    empty = F.array().cast("array<string>")
    out = out.select(key, "sentence", "sentence_start", *[F.coalesce(c, empty).alias(c) for c in ("actors", "locations", "times")], "verb_at", "verb", "action")
    parts = (F.size("actors") > 0).cast("int") + (F.size("locations") > 0).cast("int") + (F.size("times") > 0).cast("int")
    out = out.withColumn("confidence", F.round(F.lit(0.5) + F.least(0.12 * parts, F.lit(0.45)), 3)).withColumn("objects", objects_after(F.col("sentence"), F.col("verb_at")))
    return out.where(F.size("actors") >= least_actors)


def events_by_actor(evs: DataFrame, key: str) -> DataFrame:
    """(actor, n, events): an event stands under each of its actors, in order of call and place."""
    own = evs.select(F.explode("actors").alias("actor"), F.struct(key, "sentence_start", "action", "sentence").alias("e"))
    return own.groupBy("actor").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("e")).alias("events"))


def events_to_segments(evs: DataFrame, segments: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """Adds to events (key, sentence_start in the joined text) the columns ``keep`` of the segment they begin in; null without one.

    Segments of a key lie one after another, so the last one that begins at or
    before the event holds it if the event begins before its end.
    """
    at = character_offsets(segments, key, order).select(F.col(key).alias("_k"), F.col("at").alias("_p"), F.struct("until", *keep).alias("_seg"))
    rows = evs.select(F.struct(*evs.columns).alias("_ev"), F.col(key).alias("_k"), F.col("sentence_start").cast("long").alias("_p"))
    both = rows.withColumn("_seg", F.lit(None).cast(at.schema["_seg"].dataType)).unionByName(at.withColumn("_p", F.col("_p").cast("long")).withColumn("_ev", F.lit(None).cast(rows.schema["_ev"].dataType)))
    w = Window.partitionBy("_k").orderBy("_p", F.col("_ev").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(w)).where("_ev is not null")
    held = F.col("_p") < F.col("_seg.until")
    return placed.select("_ev.*", *[F.when(held, F.col(f"_seg.{c}")).alias(c) for c in keep])


def triples(evs: DataFrame, key: str) -> DataFrame:
    """(key, subject, relation, object): actors with places, times and each other, by nested explodes."""
    at = evs.select(key, "action", F.explode("actors").alias("subject"), "locations", "times")
    places = at.select(key, "subject", F.concat("action", F.lit("_at")).alias("relation"), F.explode("locations").alias("object"))
    times = at.select(key, "subject", F.concat("action", F.lit("_on")).alias("relation"), F.explode("times").alias("object"))
    pairs = evs.select(key, "action", "actors", F.posexplode("actors").alias("i", "subject"))
    pairs = pairs.select(key, "subject", F.concat("action", F.lit("_with")).alias("relation"), "i", F.posexplode("actors").alias("j", "object")).where("i < j").drop("i", "j")
    return places.unionByName(times).unionByName(pairs)


def character_offsets(segments: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Adds [at, until) of each segment in the joined text of its key (segments are one space apart)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    return segments.withColumn("at", at).withColumn("until", F.col("at") + F.length(text) + 1)
