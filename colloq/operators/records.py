"""Records kept about calls: manifests and splits, reviews and jobs, voiceprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors
from ..shared import durable


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key; logs are append-only and this is their present state."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_manifests(parts: list[DataFrame]) -> DataFrame:
    """Clips of all manifests; of a repeated clip_id the first one stays, by manifest and by place in it."""
    every = None
    for i, part in enumerate(parts):
        part = part.withColumn("_src", F.lit(i)).withColumn("_pos", F.monotonically_increasing_id())
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return latest(every, ["clip_id"], F.col("_src"), F.col("_pos")).drop("_src", "_pos")


def manifest_totals(clips: DataFrame) -> DataFrame:
    return clips.agg(F.count("*").alias("total_clips"), F.sum("duration").alias("total_duration"))


def manifest_document(clips: DataFrame, version: str = "1.0") -> DataFrame:
    """One JSON document with the totals and every clip, for small manifests; large ones are written as tables."""
    by_id = lambda a, b: F.when(a["clip_id"] < b["clip_id"], -1).when(a["clip_id"] > b["clip_id"], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct(*clips.columns)), by_id)
    one = clips.agg(F.count("*").alias("total_clips"), F.round(F.sum("duration"), 2).alias("total_duration_sec"), F.round(F.sum("duration") / 3600, 3).alias("total_duration_hours"), listed.alias("clips"))
    return one.select(F.to_json(F.struct(F.lit(version).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "*")).alias("value"))


def usable_clips(clips: DataFrame, least_chars: int = 10, shortest: float = 3.0, longest: float = 30.0, arabic: bool = False, most: int | None = None) -> DataFrame:
    """Clips with a transcript of some length, and of a fit duration; ``arabic`` asks for Arabic text, ``most`` keeps so many, by clip_id."""
    out = clips.where(F.coalesce(F.length(F.trim("transcript")), F.lit(0)) >= least_chars).where(F.col("duration").between(shortest, longest))
    out = out.where(tx.is_arabic(F.col("transcript"))) if arabic else out
    return out if most is None else out.orderBy("clip_id").limit(most)


def split_by_speaker(clips: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split; no speaker is in two. Speakers in seeded hash order fill train, then validation, the rest is test.

    Each choice depends on all before it, so one task reads one row per
    speaker, sorted, and keeps two sums. Clips without a speaker are dealt by
    their own hash to the same ratios.
    """
    kind = clips.schema["speaker_id"].dataType.simpleString()
    sizes = clips.where("speaker_id is not null").groupBy("speaker_id").agg(F.count("*").alias("n")).withColumn("o", F.xxhash64(F.lit(seed), F.col("speaker_id")))
    total = clips.count()
    quota = int(total * train), int(total * val)

    def fill(batches):
        used = [0, 0]
        for pdf in batches:
            out = []
            for n in pdf["n"]:
                at = next((i for i in (0, 1) if used[i] + n <= quota[i]), 2)
                if at < 2:
                    used[at] += n
                out.append(("train", "val", "test")[at])
            yield pdf[["speaker_id"]].assign(split=out)

    placed = sizes.repartition(1).sortWithinPartitions("o", "speaker_id").select("speaker_id", "n").mapInPandas(fill, f"speaker_id {kind}, split string")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("clip_id")), F.lit(1000)) / 1000
    alone = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return clips.drop("split").join(placed, "speaker_id", "left").withColumn("split", F.coalesce("split", alone))


def split_random(clips: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("clip_id")), F.lit(10_000)) / 10_000
    return clips.drop("split").withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def split_stats(clips: DataFrame, full: bool = False) -> DataFrame:
    """(split, n, speakers, dialects), and with ``full`` percent, hours and genders."""
    g = clips.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("speaker_id").alias("speakers"), F.array_join(F.sort_array(F.collect_set("dialect")), ",").alias("dialects"))
    if not full:
        return g
    more = clips.groupBy(F.col("split").alias("_s")).agg(F.round(F.sum("duration") / 3600, 3).alias("hours"), F.array_join(F.sort_array(F.collect_set("gender")), ",").alias("genders"))
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1)  # one row a split
    return g.join(more, g["split"].eqNullSafe(more["_s"])).drop("_s").withColumn("percent", share)


def leaked_speakers(clips: DataFrame) -> DataFrame:
    """(speaker_id, splits) of speakers that are in more than one split."""
    return clips.where("speaker_id is not null").groupBy("speaker_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def validation_report(clips: DataFrame, least_hours: float = 10, least_speakers: int = 4, least_dialects: int = 2, least_gender: float = 0.2, files: DataFrame | None = None) -> DataFrame:
    """(check, level, value): one aggregate, then one row for each rule.

    With a column split, speakers in several splits are an error; with
    ``files`` (path), clips whose audio_path is not among them are.
    """
    n = F.col("n")
    known = F.when(F.col("dialect") != "unknown", F.col("dialect"))
    one = clips.agg(
        F.count("*").alias("n"), (F.sum("duration") / 3600).alias("hours"), F.count_distinct("speaker_id").alias("speakers"), F.count_distinct(known).alias("dialects"),
        F.count_if(F.col("gender") == "female").alias("female"), F.count_if(F.col("gender") == "male").alias("male"),
        F.count_if(F.coalesce(F.trim("transcript"), F.lit("")) == "").alias("empty"), F.count_if((F.trim("transcript") != "") & (F.size(F.split(F.trim("transcript"), r"\s+")) < 2)).alias("short"),
    )
    row = lambda name, bad, value, worst="error": F.struct(F.lit(name).alias("check"), F.when(F.coalesce(bad, F.lit(True)), worst).otherwise("ok").alias("level"), value.cast("double").alias("value"))
    share = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    rules = [
        row("clips", n == 0, n), row("hours", F.col("hours") < least_hours, F.col("hours"), "warn"), row("speakers", F.col("speakers") < least_speakers, F.col("speakers")),
        row("dialects", F.col("dialects") < least_dialects, F.col("dialects"), "warn"), row("female", share("female") < least_gender, share("female"), "warn"), row("male", share("male") < least_gender, share("male"), "warn"),
        row("empty_transcripts", F.col("empty") > 0, F.col("empty")), row("short_transcripts", F.col("short") > 0.05 * n, F.col("short"), "warn"),
    ]
    if "split" in clips.columns:
        one = one.crossJoin(leaked_speakers(clips).agg(F.count("*").alias("leaks")))  # one row each
        rules.append(row("leakage", F.col("leaks") > 0, F.col("leaks")))
    if files is not None:
        there = files.select(F.col("path").alias("audio_path")).distinct()
        one = one.crossJoin(clips.join(there, "audio_path", "left_anti").agg(F.count("*").alias("missing")))  # one row each
        rules.append(row("files", F.col("missing") > 0, F.col("missing")))
    return one.select(F.inline(F.array(*rules)))


def reviewed(ents: DataFrame, reviews: DataFrame, key: str = "entity_id") -> DataFrame:
    """Entities with their latest review, or pending."""
    now = latest(reviews, [key], F.desc("reviewed_at")).select(key, "review_status")
    return ents.join(now, key, "left").withColumn("review_status", F.coalesce("review_status", F.lit("pending")))


def pending(ents: DataFrame, reviews: DataFrame, key: str = "entity_id", k: int = 50) -> DataFrame:
    """The k least sure entities without a review, with how many there are."""
    open_ = ents.join(reviews.select(key).distinct(), key, "left_anti")
    return open_.crossJoin(open_.agg(F.count("*").alias("total_pending"))).orderBy("confidence", key).limit(k)  # the right side is one row


def voiceprints(samples: DataFrame, key: str = "speaker_id", vector: str = "embedding") -> DataFrame:
    """(speaker, n, centroid, agreement, status) from samples; few or scattered samples make a voiceprint new or unstable."""
    c = vectors.centroids(samples, key, vector).withColumn("centroid", vectors.unit(F.col("centroid")))
    sims = samples.join(c.select(key, "centroid"), key).select(key, vectors.dot(vectors.unit(F.col(vector)), F.col("centroid")).alias("s"))
    out = c.join(sims.groupBy(key).agg(F.avg("s").alias("agreement")), key)
    status = F.when(F.col("n") == 0, "unknown").when(F.col("n") < 3, "new").when(F.col("agreement") >= 0.92, "stable").when(F.col("agreement") >= 0.85, "new").otherwise("unstable")
    return out.withColumn("status", status)


def identify(queries: DataFrame, registry: DataFrame, item: str, vector: str = "embedding", k: int = 3, threshold: float = 0.85, part: int = 50_000) -> DataFrame:
    """(item, rank, speaker_id, similarity, known) of the k nearest voiceprints (cosine; ties by speaker).

    The registry goes to the workers in parts of about ``part`` voiceprints (40
    MB at 192 numbers); each Arrow batch is one matrix product with a part and
    keeps k rows an item, and the parts' best are ranked together. An item
    without a vector, or an empty registry, gives no rows.
    """
    spark = queries.sparkSession
    voices = registry.select("speaker_id", F.transform("centroid", lambda x: x.cast("double")).alias("centroid"))
    parts = max(1, -(-voices.count() // part))
    kind, of = queries.schema[item].dataType.simpleString(), voices.schema["speaker_id"].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select(item, vectors.unit(F.col(vector)).alias("q"))
    best = None
    for p in range(parts):
        own = voices.where(F.pmod(F.xxhash64("speaker_id"), F.lit(parts)) == p).orderBy("speaker_id").toPandas()
        if not len(own):
            continue
        shared = spark.sparkContext.broadcast((own["speaker_id"].to_numpy(), np.stack(own["centroid"].to_numpy()).T))

        def run(batches, shared=shared):
            names, table = shared.value
            for pdf in batches:
                if len(pdf):
                    s = np.stack(pdf["q"].to_numpy()) @ table
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({item: np.repeat(pdf[item].to_numpy(), top.shape[1]), "speaker_id": names[top.ravel()], "similarity": np.take_along_axis(s, top, 1).ravel()})

        found = asked.mapInPandas(run, f"{item} {kind}, speaker_id {of}, similarity double")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = spark.createDataFrame([], f"{item} {kind}, speaker_id {of}, similarity double")
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("similarity"), "speaker_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("known", F.col("similarity") >= threshold).select(item, "speaker_id", "similarity", "rank", "known")


def similarities(df: DataFrame, item: str, vector: str = "embedding", least: float = 0.9, block: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs a < b whose cosine is at least ``least``: a blocked matrix product.

    Items are dealt by hash to blocks; each pair of blocks is one task's
    product of two matrices, and only pairs above ``least`` leave it. The work
    grows with the square of the table, as the result is defined; a row is
    shipped once for each block. Blocks hold a sixteenth of the table, from
    2,048 to 16,384 rows, and a product is made in tiles of 2,048, so few
    blocks need no more memory.
    """
    kind, tile = df.schema[item].dataType.simpleString(), 2048
    rows = df.count()
    n = max(1, -(-rows // (block or max(tile, min(8 * tile, rows // 16)))))
    own = df.where(F.col(vector).isNotNull()).select(item, vectors.unit(F.col(vector)).alias("v"), F.pmod(F.xxhash64(item), F.lit(n)).cast("int").alias("own"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", item, "v")

    def run(key, pdf):
        pdf = pdf.sort_values(item)
        left, right = pdf[pdf["own"] == key[0]], pdf[pdf["own"] == key[1]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": left[item][:0], "b": left[item][:0], "similarity": np.zeros(0)})
        x, y, found = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()).T, []
        for lo in range(0, len(x), tile):
            for at in range(0, y.shape[1], tile):
                s = x[lo : lo + tile] @ y[:, at : at + tile]
                i, j = np.nonzero(s >= least)
                found.append((i + lo, j + at, s[i, j]))
        i, j, c = (np.concatenate(parts) for parts in zip(*found))
        a, b = left[item].to_numpy()[i], right[item].to_numpy()[j]
        keep = a < b if key[0] == key[1] else np.ones(len(a), bool)
        lo, hi = np.where(a < b, a, b), np.where(a < b, b, a)
        return pd.DataFrame({"a": lo[keep], "b": hi[keep], "similarity": c[keep]})

    return spread.groupBy("p", "q").applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def assign_clusters(centroids: DataFrame, registry: DataFrame, exclusive: float = 0.95, threshold: float = 0.85) -> DataFrame:
    """(call_id, cluster, speaker_id or null): within a call a speaker is given once, in order of cluster, unless the likeness is above ``exclusive``."""
    ids = F.concat_ws("|", "call_id", "cluster").alias("item")
    near = identify(centroids.select("call_id", "cluster", ids, "embedding"), registry, "item")
    parts = near.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", "speaker_id", "similarity"))).alias("c"))
    parts = parts.join(centroids.select("call_id", "cluster", ids), "item")
    order = F.array_sort(F.collect_list(F.struct("cluster", "c")))
    kind = registry.schema["speaker_id"].dataType.simpleString()
    acc0 = F.array().cast(f"array<struct<cluster:long,speaker_id:{kind},similarity:double>>")

    def step(acc, x):
        used = lambda s: F.exists(acc, lambda y: y["speaker_id"] == s)
        first = x["c"][0]
        open_ = F.filter(x["c"], lambda y: (y["similarity"] >= threshold) & ~F.coalesce(used(y["speaker_id"]), F.lit(False)))
        free = (first["similarity"] >= threshold) & (~F.coalesce(used(first["speaker_id"]), F.lit(False)) | (first["similarity"] >= exclusive))
        best = F.when(free, first).otherwise(F.get(open_, F.lit(0)))
        return F.array_append(acc, F.struct(x["cluster"].cast("long").alias("cluster"), best["speaker_id"].alias("speaker_id"), first["similarity"].alias("similarity")))

    return parts.groupBy("call_id").agg(order.alias("o")).select("call_id", F.inline(F.aggregate("o", acc0, step)))


def auto_registered(registry: DataFrame, centroids: DataFrame, threshold: float = 0.85, exclusive: float = 0.95, prefix: str = "SPK_", most_voices: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """What calls do to a registry that grows as they come: (assignments, samples).

    ``registry`` has (speaker_id, centroid, n), ``centroids`` (call_id, cluster,
    embedding). Calls are taken in order of call_id, clusters in order of
    number. A cluster goes to its nearest voiceprint if that is like enough,
    and not twice within a call unless the likeness is above ``exclusive``;
    else to the next of the three nearest that is; else it becomes a new
    speaker, numbered on. Every cluster is a sample of its speaker: assignments
    have (call_id, cluster, speaker_id, similarity, status), samples
    (speaker_id, embedding, call_id).

    Each choice depends on all before it, so one task reads the sorted
    clusters and holds the voiceprints, of which there may be ``most_voices``.
    """
    known = registry.select("speaker_id", F.transform("centroid", lambda x: x.cast("double")).alias("centroid"), F.col("n").cast("long").alias("n"))
    if known.limit(most_voices + 1).count() > most_voices:
        raise ValueError(f"one task can hold at most {most_voices} voiceprints; register calls in regions")
    marked = known.select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("cluster"), F.col("speaker_id").cast("string").alias("speaker_id"), F.col("centroid").alias("v"), "n")
    asked = centroids.select(F.lit(1).alias("part"), F.col("call_id").cast("string").alias("call_id"), F.col("cluster").cast("long").alias("cluster"), F.lit(None).cast("string").alias("speaker_id"), vectors.unit(F.col("embedding")).alias("v"), F.lit(0).cast("long").alias("n"))

    def run(batches):
        names, sums, units = [], [], []
        call, used = None, set()
        for pdf in batches:
            out = []
            for part, call_id, cluster, name, v, n in zip(pdf["part"], pdf["call_id"], pdf["cluster"], pdf["speaker_id"], pdf["v"], pdf["n"]):
                v = np.asarray(v, float)
                if part == 0:
                    names.append(name)
                    sums.append(v * max(1, n))
                    units.append(v / max(np.linalg.norm(v), 1e-12))
                    continue
                if call_id != call:
                    call, used = call_id, set()
                s = np.stack(units) @ v if units else np.zeros(0)
                order = np.argsort(-s, kind="stable")[:3]
                at = None
                if len(order) and s[order[0]] >= threshold:
                    first = order[0]
                    at = first if names[first] not in used or s[first] >= exclusive else next((i for i in order[1:] if names[i] not in used and s[i] >= threshold), None)
                if at is None:
                    number = 1 + max([int(x[len(prefix):]) for x in names if x.startswith(prefix) and x[len(prefix):].isdigit()], default=0)
                    at = len(names)
                    names.append(f"{prefix}{number:02d}")
                    sums.append(v.copy())
                    units.append(v.copy())
                    found, status = 1.0, "new"
                else:
                    found, status = float(s[at]), "known"
                    sums[at] = sums[at] + v
                    units[at] = sums[at] / max(np.linalg.norm(sums[at]), 1e-12)
                used.add(names[at])
                out.append((call_id, int(cluster), names[at], found, status, v.tolist()))
            yield pd.DataFrame(out, columns=["call_id", "cluster", "speaker_id", "similarity", "status", "embedding"])

    rows = marked.unionByName(asked).repartition(1).sortWithinPartitions("part", "call_id", "cluster", "speaker_id")
    done = durable(rows.mapInPandas(run, "call_id string, cluster long, speaker_id string, similarity double, status string, embedding array<double>"))
    return done.drop("embedding"), done.select("speaker_id", "embedding", "call_id")
