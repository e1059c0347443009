"""Streams of feedback, clicks, decisions, word selections and probes.

Late rows: every stream takes one watermark; rows later than it are dropped by Spark and are
counted in the query's progress.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Types
from pyspark.sql.streaming import StreamingQuery

from smsight.functions import text as T, vocab as V
from smsight.operators import bandit, recommender
from smsight.session import scratch_path
from smsight.sources import tables
from smsight.streaming import state


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files arriving below ``path`` (a folder or a pattern)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, keys: list[str] = (), name: str = "stream") -> DataFrame:
    """Process what has arrived, into a table of the shared folder, and return that table.

    Each micro-batch writes its own folder, so a repeated batch replaces itself.  With ``keys``
    a batch writes only the groups that it changed (update mode, so the watermark clears the
    state), and the newest row of each group is returned; without, rows are appended.
    """
    spark = stream.sparkSession
    out, saved = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    _process(stream, out, saved, bool(keys))
    return _newest(stream, out, list(keys))


def run_arrivals(stream: DataFrame, feeds: dict[str, list[DataFrame]], keys: list[str] = (), name: str = "stream") -> DataFrame:
    """Like :func:`run_available`, for input that arrives part by part.

    ``feeds`` maps the folders that ``stream`` reads to the parts that come into them. After each part the query is
    started again from its checkpoint, so state, watermarks and recovery go through several batches.
    """
    spark = stream.sparkSession
    out, saved = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    for number in range(max(map(len, feeds.values()))):
        for folder, parts in feeds.items():
            if number < len(parts):
                parts[number].write.mode("append").parquet(folder)
        _process(stream, out, saved, bool(keys))
    return _newest(stream, out, list(keys))


def _process(stream: DataFrame, out: str, checkpoint: str, update: bool) -> None:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode("update" if update else "append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _newest(stream: DataFrame, out: str, keys: list[str]) -> DataFrame:
    schema = Types.StructType([*stream.schema, Types.StructField("batch", Types.IntegerType())])
    written = stream.sparkSession.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
    return newest_of(written, keys, "batch") if keys else written.drop("batch")


def newest_of(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the newest version of every key."""
    others = [c for c in changes.columns if c not in (*keys, version)]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_row")).select(*keys, "_row.*")


# --- feedback and clicks ------------------------------------------------------------------------

def feedback_status(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stream of feedback joined to the stored decisions: ``updated`` or ``not_found``."""
    return bandit.join_feedback(feedback, decisions)


def feedback_status_streams(feedback: DataFrame, decisions: DataFrame, delay: str = "1 day", wait: str = "90 days") -> DataFrame:
    """Both sides as streams.  A decision is kept ``wait`` long; unanswered feedback comes out
    as ``not_found`` once the watermark has passed it."""
    left = feedback.withWatermark("received_at", delay).withColumnRenamed("sms_id", "f_sms_id")
    right = decisions.select("sms_id", "context_key", "recommended_hour", "decided_at").withWatermark("decided_at", delay)
    near = (
        (F.col("f_sms_id") == F.col("sms_id")) & (F.col("received_at") >= F.col("decided_at"))
        & (F.col("received_at") <= F.col("decided_at") + F.expr(f"INTERVAL {wait}")))
    return left.join(right, near, "left").withColumn(
        "status", F.when(F.col("context_key").isNull(), "not_found").otherwise("updated"))


def first_clicks(clicks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each message's click counts once while it is inside the watermark."""
    return clicks.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["sms_id"])


def distinct_requests(requests: DataFrame, ttl: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Answer equal requests once per time bucket (1 hour for timing, 300 seconds for words)."""
    return requests.withColumn("bucket", F.window("requested_at", ttl).start).withWatermark(
        "requested_at", delay).dropDuplicatesWithinWatermark(["request_key", "bucket"])


def live_decisions(decisions: DataFrame, ttl_days: int = V.DECISION_TTL_DAYS) -> DataFrame:
    """Decisions that the watermark has not expired yet."""
    return decisions.withWatermark("decided_at", f"{ttl_days} days").withColumn(
        "expires_at", F.col("decided_at") + F.make_dt_interval(days=F.lit(ttl_days)))


# --- bandit state -------------------------------------------------------------------------------------

def start_bandit_updates(
    feedback: DataFrame, state_path: str, checkpoint: str, every: str | None = "5 minutes", decay: float = V.BANDIT_DECAY,
) -> StreamingQuery:
    """Keep the bandit parameters up to date, one snapshot per micro-batch.

    A batch is sorted and folded by range partition and then chained onto the previous
    snapshot, so a hot context neither fills a task nor the state store.  The snapshot of a
    repeated batch starts from the same predecessor and replaces itself.  Events that arrive
    in a later batch count after those of earlier batches.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = None if number == 0 else spark.read.parquet(f"{state_path}/version={number - 1:012d}")
        tables.save_bandit_state(bandit.replay_bandit(batch, before, decay), state_path, number)

    writer = feedback.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def start_bandit_state(
    feedback: DataFrame, path: str, checkpoint: str, every: str | None = "5 minutes", decay: float = V.BANDIT_DECAY,
    delay: str = "1 day", compact_every: int = 12,
) -> StreamingQuery:
    """Keep the bandit parameters by a stateful processor: a batch writes the contexts that it changed, nothing else.

    Every ``compact_every`` batches the changes become a new base and the older ones are deleted, so neither a batch nor
    the folder grows with the number of batches. A batch that is repeated writes the same folder again; one that has
    been compacted already is ignored by :func:`read_bandit_state`.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if (number + 1) % compact_every == 0:
            compact_bandit_state(batch.sparkSession, path, number)

    writer = state.bandit_updates(feedback, decay, delay).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


BANDIT_STATE = "context_key string, hour int, alpha double, beta double, n_updates long, batch int"


def _bandit_changes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All changes behind the newest base, with that base as its last batch, and the number of that batch."""
    folders = tables.folder_names(spark, path)
    upto = max((int(f.split("=")[1]) for f in folders if f.startswith("base=")), default=-1)
    changes = [f"{path}/changes/{f}" for f in tables.folder_names(spark, f"{path}/changes") if int(f.split("=")[1]) > upto]
    parts = [spark.read.schema(BANDIT_STATE).option("basePath", f"{path}/changes").parquet(*changes)] if changes else []
    if upto >= 0:
        parts.append(spark.read.schema(BANDIT_STATE).parquet(f"{path}/base={upto}").withColumn("batch", F.lit(upto)))
    rows = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else spark.createDataFrame([], BANDIT_STATE)
    return rows, upto


def read_bandit_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest parameters of every context and hour."""
    return newest_of(_bandit_changes(spark, path)[0], bandit.KEYS, "batch")


def compact_bandit_state(spark: SparkSession, path: str, number: int) -> None:
    """Make the state after batch ``number`` the base and delete older bases and changes."""
    rows, upto = _bandit_changes(spark, path)
    if number <= upto:
        return
    newest_of(rows.where(F.col("batch") <= number), bandit.KEYS, "batch").write.mode("overwrite").parquet(f"{path}/base={number}")
    old = [f"{path}/{f}" for f in tables.folder_names(spark, path) if f.startswith("base=") and int(f.split("=")[1]) < number]
    old += [f"{path}/changes/{f}" for f in tables.folder_names(spark, f"{path}/changes") if int(f.split("=")[1]) <= number]
    for folder in old:
        tables.delete_folder(spark, folder)


# --- word selections, drift, volume -------------------------------------------------------------------------

def selection_counts(feedback: DataFrame, span: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Selected words per language and hour of the event, each event id once."""
    return feedback.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"]).groupBy(
        F.window("created_at", span).alias("span"), T.detect_language("partial_text").alias("lang"),
        F.col("selected_word").alias("word"),
    ).agg((F.count("*") * V.FEEDBACK_FREQ).alias("freq"))


def merge_selections(words: DataFrame, closed: DataFrame) -> DataFrame:
    """Lexicon after the counts of hours; languages without words count as French."""
    counted = closed.select(recommender.served_by(F.col("lang"), words).alias("lang"), "word", "freq")
    return words.select("lang", "word", "freq").unionByName(counted).groupBy(
        "lang", "word").agg(F.sum("freq").alias("freq"))


def daily_rates(decisions: DataFrame, span: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Labelled decisions and engaged ones per context in sliding spans."""
    return decisions.where(F.col("engaged").isNotNull()).withWatermark("decided_at", delay).groupBy(
        F.window("decided_at", span, slide).alias("span"), "context_key",
    ).agg(F.count("*").alias("n"), F.sum(F.col("engaged").cast("int")).alias("n_eng"))


def drift_from_days(days: DataFrame, now: Column) -> DataFrame:
    """Drift test on one-day counts (``span`` one day long): the last 7 days against 7..30 days."""
    start = F.col("span.start")
    recent = start >= now - F.expr("INTERVAL 7 DAYS")
    inside = days.where((start >= now - F.expr("INTERVAL 30 DAYS")) & (start < now))
    rates = inside.groupBy("context_key").agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.when(recent, F.col("n_eng"))), F.sum(F.when(recent, F.col("n")))).alias("recent_rate"),
        F.try_divide(F.sum(F.when(~recent, F.col("n_eng"))), F.sum(F.when(~recent, F.col("n")))).alias("older_rate"))
    drift = (F.col("n") >= V.DRIFT_MIN_ROWS) & (F.col("recent_rate") < F.col("older_rate") * V.DRIFT_RATIO)
    return rates.withColumn("drift", F.coalesce(drift, F.lit(False)))


def recent_volume(messages: DataFrame, span: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Messages per recipient in sliding days."""
    return messages.withWatermark("send_datetime", delay).groupBy(
        F.window("send_datetime", span, slide).alias("span"), "msisdn").agg(F.count("*").alias("n"))


def sliding_volume(messages: DataFrame, span: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Messages per recipient in every span that ends on a ``slide``, once the watermark has closed it.

    Messages are first counted per recipient and slide; Spark clears those counts behind the watermark. A processor keeps the
    counts of the last ``span`` and gives out runs of ends with the same number of messages, so neither a shuffle nor the
    state holds a row for each span and recipient: the spans are made from the runs last. Append mode.
    """
    sums = messages.withWatermark("send_datetime", delay).groupBy(F.window("send_datetime", slide).alias("part"), "msisdn").agg(F.count("*").alias("part_n"))
    counts = sums.select("msisdn", F.window_time("part").alias("event_at"), F.unix_micros("part.start").alias("start"), F.col("part_n").alias("n"))
    span_us, slide_us = (pd.Timedelta(x) // pd.Timedelta(microseconds=1) for x in (span, slide))
    runs = state.sliding_runs(counts, span_us, slide_us)
    ends = runs.select("msisdn", "n", F.explode(F.sequence("first_end", "last_end", F.lit(slide_us))).alias("end"))
    return ends.select(
        F.struct(F.timestamp_micros(F.col("end") - span_us).alias("start"), F.timestamp_micros("end").alias("end")).alias("span"), "msisdn", "n")
