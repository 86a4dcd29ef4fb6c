"""Conversations from message rows, by keyed streaming state with event-time watermarks.

The rows are read as a stream.  Session-window state, keyed by (peer, era), holds a conversation open
until the watermark passes its last message by the gap; rows that arrive late join it meanwhile.  On
closure the conversation is emitted with the facts its validation needs.  Eras are fixed spans of time
that spread the state of a hot peer over many keys; the pieces of a conversation that crosses an era's
border are stitched together by pointer doubling afterwards.

A bounded run reads what is there in one batch, so that no row is late, and ends with a sentinel row far
in the future that drives the watermark past every conversation.  A run in several batches (``files`` at a
time) takes late rows into their conversations as long as the watermark has not passed them; rows later
than that are left out and counted.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorespark.operators.joins import points_in
from lorespark.operators.sessions import resolve_roots
from lorespark.session import Stage, scratch_path

GAP_SECONDS = 180 * 60
ERA_SECONDS = 30 * 86400
OWN_SENDER = "Вы"
SENTINEL = "9998-12-31 00:00:00"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def is_broken() -> Column:
    """A row without speaker, or whose speaker and side disagree; a null side disagrees with any speaker."""
    blank = F.col("sender").isNull() | (F.regexp_replace("sender", r"(?U)[\s\x{200B}\x{FEFF}]", "") == "")
    return blank | F.coalesce((F.col("sender") == OWN_SENDER) != F.col("is_own"), F.lit(True))


def message_stream(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A stream of a table's folder, or of a table that is one file; at most ``files`` files a batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, name = os.path.split(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def pieces(messages: DataFrame, gap_seconds: int, era_seconds: int, watermark: str) -> DataFrame:
    """Streaming: one row per (peer, era, session window) once it is closed."""
    at = F.struct(F.unix_micros("sent_at").alias("us"), F.col("vk_msg_id").alias("vk"))
    return (messages.withColumn("era", F.floor(F.unix_seconds("sent_at") / era_seconds).cast("long"))
            .withWatermark("sent_at", watermark)
            .groupBy(F.session_window("sent_at", f"{gap_seconds} seconds").alias("w"), "peer_id", "era")
            .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min("vk_msg_id").alias("vk_min"), F.max("vk_msg_id").alias("vk_max"),
                 F.count("*").alias("n_rows"), F.max(is_broken()).alias("broken"),
                 F.max(F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))).alias("speaks"),
                 F.max(F.coalesce(F.col("is_own"), F.lit(False))).alias("any_own"), F.min(F.coalesce(F.col("is_own"), F.lit(False))).alias("all_own"))
            .drop("w"))


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings and catalog, whose settings may be changed without others seeing it."""
    return SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())


def run_stream(spark: SparkSession, source: DataFrame, gap_seconds: int = GAP_SECONDS, era_seconds: int = ERA_SECONDS, watermark: str = "1 day", several: bool = False) -> tuple[str, int]:
    """Drain a stream of (peer_id, vk_msg_id, sent_at, sender, is_own, text): the folder of its closed pieces, and the number of rows that came too late.

    ``spark`` is a session of the stream's own.  ``several``: the source comes in several batches; the sentinel
    that closes all comes after them, in a run of its own.
    """
    base = scratch_path(spark, "conversations")
    spark.createDataFrame([(SENTINEL,)], "at string").select(F.to_timestamp("at").alias("sent_at")).coalesce(1).write.parquet(f"{base}/sentinel")
    rows = source.where("peer_id is not null and vk_msg_id is not null and sent_at is not null")
    for k, v in {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true", "spark.sql.streaming.minBatchesToRetain": "2"}.items():
        spark.conf.set(k, v)
    late, ends = 0, f"{base}/ends"
    spark.createDataFrame([], "sent_at timestamp").coalesce(1).write.parquet(ends)
    for last in (False, True) if several else (True,):  # the second run finds the sentinel only
        if last:
            spark.read.schema("sent_at timestamp").parquet(f"{base}/sentinel").write.mode("append").parquet(ends)
        sentinel = spark.readStream.schema("sent_at timestamp").parquet(ends)
        query = (pieces(rows.unionByName(sentinel, allowMissingColumns=True), gap_seconds, era_seconds, watermark).writeStream.format("parquet").outputMode("append")
                 .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        query.awaitTermination()
        late += sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    return f"{base}/out", late


def stitch(parts: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Join the pieces that an era's border divided."""
    parts = Stage(parts.sparkSession, "conversation-parts").cut(parts.withColumn("node", F.col("first.us")))
    edge = parts.groupBy("peer_id", "era").agg(F.min(F.struct("first", "node")).alias("lo"), F.max(F.struct("last", "node")).alias("hi"))
    links = (edge.select("peer_id", "era", F.col("lo.first.us").alias("us"), F.col("lo.node").alias("node"))
             .join(edge.select("peer_id", (F.col("era") + 1).alias("era"), F.col("hi.last.us").alias("prev"), F.col("hi.node").alias("ptr")), ["peer_id", "era"])
             .where(F.col("us") - F.col("prev") <= gap_seconds * 1_000_000).select("peer_id", "node", "ptr"))
    roots = resolve_roots(links, ["peer_id"], name="conversation-links")
    return (parts.join(roots, ["peer_id", "node"], "left").groupBy("peer_id", F.coalesce("ptr", "node").alias("root"))
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("vk_min").alias("vk_min"), F.max("vk_max").alias("vk_max"), F.sum("n_rows").alias("n_rows"),
                 F.max("broken").alias("broken"), F.max("speaks").alias("speaks"), F.max("any_own").alias("any_own"), F.min("all_own").alias("all_own")))


def conversations(spark: SparkSession, path: str, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """(peer_id, root_us, msg_from, msg_to, started_us, ended_us, n_rows, broken, empty, missing_reply) per conversation.

    A row without peer, id or time belongs to no conversation; a row without time but with an id between
    the smallest and largest of a conversation breaks it.  Repeated rows change nothing, as every fact is
    an any, an all, a smallest or a largest.  A null side counts as the other's.  No message: no row.
    """
    table = spark.read.parquet(path)
    cols = ["peer_id", "vk_msg_id", "sent_at", "sender", "is_own", "text"]
    own = own_session(spark)
    closed, _ = run_stream(own, message_stream(own, path, table.schema).select(*cols), gap_seconds)  # one batch: none is late
    whole = Stage(spark, "conversations-whole").cut(stitch(spark.read.parquet(closed).where("peer_id is not null"), gap_seconds))
    lost = table.where("sent_at is null and peer_id is not null and vk_msg_id is not null").select("peer_id", "vk_msg_id")
    hit = points_in(lost.distinct(), whole.select("peer_id", "root", "vk_min", "vk_max"), ["peer_id"], "vk_msg_id", "vk_min", "vk_max").select("peer_id", "root").distinct().withColumn("gap", F.lit(True))
    return whole.join(hit, ["peer_id", "root"], "left").select(
        "peer_id", F.col("root").alias("root_us"), F.col("first.vk").alias("msg_from"), F.col("last.vk").alias("msg_to"), F.col("first.us").alias("started_us"),
        F.col("last.us").alias("ended_us"), "n_rows", (F.col("broken") | F.coalesce("gap", F.lit(False))).alias("broken"),
        (~F.col("speaks")).alias("empty"), (F.col("all_own") | ~F.col("any_own")).alias("missing_reply"))


def turns(spark: SparkSession, path: str, kept: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Rows of the kept conversations: (peer_id, msg_from, vk_msg_id, sent_us, speaker, text), repeated rows once.

    Every bucket as wide as the gap meets one conversation at most, so rows find theirs by equality.
    """
    gap = gap_seconds * 1_000_000
    spans = kept.withColumn("b", F.explode(F.sequence(F.floor(F.col("started_us") / gap), F.floor(F.col("ended_us") / gap)))).select("peer_id", "b", "msg_from", "started_us", "ended_us")
    rows = (spark.read.parquet(path).where("sent_at is not null").withColumn("us", F.unix_micros("sent_at")).withColumn("b", F.floor(F.col("us") / gap))
            .groupBy("peer_id", "vk_msg_id", "b", "us").agg(F.min_by(F.struct("is_own", "text"), "id").alias("m")))
    return (rows.join(spans, ["peer_id", "b"]).where(F.col("us").between(F.col("started_us"), F.col("ended_us")))
            .select("peer_id", "msg_from", "vk_msg_id", F.col("us").alias("sent_us"), F.when(F.col("m.is_own"), "own").otherwise("other").alias("speaker"), F.col("m.text").alias("text")))
