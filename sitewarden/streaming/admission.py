"""Crawl state as streams: admission of offered URLs, the state of each URL, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewarden.sources.tables import checkpoint

OFFER = "identity string, original string, depth int, via_website boolean, via_sitemap boolean, skip_reason string"
#: What becomes of an admitted URL after what event.
AFTER = {"offered": "pending", "started": "in_flight", "fetched": "fetched", "failed": "failed", "blocked": "blocked", "stopped": "pending"}


def merge_offers(offers: DataFrame) -> DataFrame:
    """One row for each identity: a repeated offer only adds provenance and lowers the depth."""
    return offers.groupBy("identity").agg(F.min_by("original", F.struct("depth", "original")).alias("original"), F.min("depth").alias("depth"), F.bool_or("via_website").alias("via_website"), F.bool_or("via_sitemap").alias("via_sitemap"), F.max("skip_reason").alias("skip_reason"))


def admit(offers: DataFrame, max_urls: int = 20_000, max_queue: int = 1024) -> DataFrame:
    """merge_offers() with state and reason. Skipped URLs are excluded and take no place; the others are admitted in
    the order (depth, identity), nulls last, until max_urls places are taken; beyond max_queue they wait.

    Places are counted by range partitions: only the first max_urls of each matter, and a sum over partitions."""
    rows = merge_offers(offers).withColumn("_d", F.coalesce("depth", F.lit(2147483647)))
    open_ = rows.where("skip_reason is null").repartitionByRange("_d", "identity").sortWithinPartitions("_d", "identity").withColumn("_id", F.monotonically_increasing_id())
    open_ = checkpoint(open_)
    counts = open_.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = open_.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(starts), "_part")
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    reason = F.when(place >= max_urls, "URL cap").when(place >= max_queue, "Queue cap").otherwise("")
    columns = ["identity", "original", "depth", "via_website", "via_sitemap"]
    admitted = placed.select(*columns, F.lit("pending").alias("state"), reason.alias("reason"))
    return admitted.unionByName(rows.where("skip_reason is not null").select(*columns, F.lit("excluded").alias("state"), F.col("skip_reason").alias("reason")))


def current_states(events: DataFrame) -> DataFrame:
    """(identity, state): what the last event (seq) of each URL makes of it."""
    states = F.create_map(*(F.lit(x) for pair in AFTER.items() for x in pair))
    return events.groupBy("identity").agg(F.max_by("event", "seq").alias("event")).select("identity", states[F.col("event")].alias("state"))


def follow_offers(stream: DataFrame, folder: str, trigger: dict | None = None):
    """Keep the merged offers of a stream in `folder`/merged, version by version: a batch is merged with the version
    before and written as the next, so a batch that is run again after a failure replaces its own version."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/merged/{number - 1}") if number else spark.createDataFrame([], OFFER)
        merge_offers(before.unionByName(batch.select(*before.columns))).write.mode("overwrite").parquet(f"{folder}/merged/{number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; on a stream, windows close when the watermark has passed them."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users: runs of events no further apart than the gap."""
    found = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def settle(windows: DataFrame, folder: str) -> DataFrame:
    """Run a windowed stream over what is there and return all its windows: each batch writes its complete result."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    query = windows.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return windows.sparkSession.read.parquet(f"{folder}/result")


def stamp_sitemap_provenance(records: DataFrame, listed: DataFrame) -> DataFrame:
    """records with via_sitemap true for the identities that a sitemap lists."""
    keys = listed.select("identity").where("identity is not null").distinct().withColumn("_listed", F.lit(True))
    return records.join(keys, "identity", "left").withColumn("via_sitemap", F.col("via_sitemap") | F.coalesce("_listed", F.lit(False))).drop("_listed")


def secondary_targets(observations: DataFrame, seen: DataFrame) -> DataFrame:
    """Addresses to probe besides pages: resources and annotated addresses over HTTPS that no record has yet."""
    found = observations.select(F.explode(F.concat(F.transform("resources", lambda r: r["destination"]), F.transform("page.hreflangs", lambda h: h["href"]))).alias("identity"))
    found = found.where(F.col("identity").startswith("https://")).distinct()
    return found.join(seen.select("identity").distinct(), "identity", "left_anti")
