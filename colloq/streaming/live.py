"""Incremental forms: session windows, graph upserts, registry updates, upload jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vectors
from ..operators.records import auto_registered, latest


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of events with no gap as long as ``gap``; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, merge) -> StreamingQuery:
    """Each batch is merged with the table's last version into the next: ``merge(old | None, batch)``.

    Versions are folders, written whole and then named by the batch, so a batch
    that is run again after a failure writes the same version again.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{n - 1}") if n else None
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_buckets(stream: DataFrame, path: str, checkpoint: str, merge, keys: list[str], buckets: int = 64) -> StreamingQuery:
    """Like upsert_stream for large tables: rows are dealt by a hash of ``keys`` to folders, and a batch rewrites only those it touches.

    ``merge(old | None, batch)`` must be such that a key's rows depend on that
    key alone. A batch writes folder ``bucket=b/v<n>``; the last version of
    each bucket is its state (:func:`read_buckets`), so a batch that is run
    again writes the same files again.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        last = _versions(spark, path, n)
        for b in touched:
            old = spark.read.parquet(f"{path}/bucket={b}/v{last[b]}") if b in last else None
            merge(old, own.where(F.col("bucket") == b).drop("bucket")).write.mode("overwrite").parquet(f"{path}/bucket={b}/v{n}")
        own.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, path: str, before: int | None = None) -> dict[int, int]:
    """The last finished version of each bucket, below ``before``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, int] = {}
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "bucket=*/v*/_SUCCESS")) or []:
        parts = status.getPath().toString().split("/")
        b, v = int(parts[-3].split("=")[1]), int(parts[-2][1:])
        if before is None or v < before:
            found[b] = max(found.get(b, -1), v)
    return found


def read_buckets(spark, path: str) -> DataFrame:
    """The present state of a table that upsert_buckets keeps."""
    return spark.read.parquet(*[f"{path}/bucket={b}/v{v}" for b, v in sorted(_versions(spark, path).items())])


def merge_edges(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Counts and call lists are sums and unions, so batches may come in any order."""
    new = batch.groupBy("source", "target", "type").agg(F.count("*").alias("count"), F.collect_set("call_id").alias("call_ids"))
    if old is None:
        return new
    both = old.unionByName(new)
    return both.groupBy("source", "target", "type").agg(F.sum("count").alias("count"), F.array_distinct(F.flatten(F.collect_list("call_ids"))).alias("call_ids"))


def merge_latest(keys: list[str], time: str):
    """Reviews and jobs: the last row of each key stays."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return latest(batch if old is None else old.unionByName(batch), keys, F.desc(time))

    return merge


#: Stages of a call's processing and how far each has come when it begins.
STAGES = (("diarization", 0.1), ("asr", 0.4), ("nlp", 0.7), ("kg", 0.9))


def job_log(calls: DataFrame, at, stage: str, progress: float, status: str = "processing", error=None) -> DataFrame:
    """Rows of the job log (job_id, call_id, at, status, stage, progress, error) for calls (call_id, job_id or not)."""
    ident = F.col("job_id") if "job_id" in calls.columns else F.concat(F.lit("job_"), F.date_format(F.lit(at), "yyyyMMdd_HHmmss"), F.lit("_"), F.col("call_id").cast("string"))
    return calls.select(ident.alias("job_id"), "call_id", F.lit(at).cast("timestamp").alias("at"), F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.lit(float(progress)).alias("progress"), F.lit(error).cast("string").alias("error"))


def process_uploads(stream: DataFrame, log: str, checkpoint: str, stages: dict, now=None) -> StreamingQuery:
    """Runs the named stages over each batch of uploads (call_id, ...) and keeps a log of jobs.

    ``stages`` has a function for each of STAGES, from what the one before it
    returned. Progress is appended to the Parquet table ``log`` as it comes; a
    stage that fails ends its batch's jobs as failed, with the error, and the
    next batch goes on. A job's id comes from its batch and call, so a batch
    that is run again adds to the same jobs.
    """
    import datetime

    clock = now or (lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None))

    def step(batch: DataFrame, n: int) -> None:
        own = batch.dropDuplicates(["call_id"]).persist()
        jobs = own.select("call_id", F.concat(F.lit(f"job_{n}_"), F.col("call_id").cast("string")).alias("job_id"))
        tell = lambda *a, **k: job_log(jobs, clock(), *a, **k).write.mode("append").parquet(log)
        tell("pending", 0.0, "pending")
        value = own
        try:
            for name, progress in STAGES:
                tell(name, progress)
                value = stages[name](value)
            tell("done", 1.0, "completed")
        except Exception as e:  # a job's failure is recorded, not raised
            tell("failed", 0.0, "failed", str(e)[:500])
        finally:
            own.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def register_stream(stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.85) -> StreamingQuery:
    """A registry that grows with a stream of clusters (call_id, cluster, embedding).

    Each batch reads the last version of ``<path>/samples``, assigns its calls
    in order, and writes the next version and ``<path>/assigned/v<n>``.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        samples = spark.read.parquet(f"{path}/samples/v{n - 1}") if n else spark.createDataFrame([], "speaker_id string, embedding array<double>, call_id string")
        voices = vectors.centroids(samples, "speaker_id", "embedding")
        assigned, fresh = auto_registered(voices, batch, threshold)
        assigned.write.mode("overwrite").parquet(f"{path}/assigned/v{n}")
        samples.unionByName(fresh).write.mode("overwrite").parquet(f"{path}/samples/v{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
