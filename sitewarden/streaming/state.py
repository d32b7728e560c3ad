"""The state of a crawl as relations: what was seen, what waits, what is taken up again after a stop, and when to retry.

Records are schemas.URL_RECORD rows. A record that waits for its turn is pending without a reason; one that a cap keeps
out is pending with the cap as its reason."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import urls as U
from sitewarden.sources.tables import ranked

#: Tries after the first, the longest wait in seconds, and the tries after which a wait no longer doubles.
RETRIES, LONGEST, DOUBLINGS = 3, 30, 4
QUEUED = ""


def record_key(identity: Column, original: Column) -> Column:
    """What a record is kept by: its address in normal form, else the text that couldn't be resolved."""
    return F.when(identity.isNotNull(), F.concat(F.lit("i:"), identity)).otherwise(F.concat(F.lit("o:"), original))


def queued() -> Column:
    return (F.col("state") == "pending") & (F.coalesce("reason", F.lit(QUEUED)) == QUEUED)


def coverage(seen: DataFrame) -> DataFrame:
    """(key, original, identity, skip_reason) of all that was seen, each once, as it was first in order. seen: (order,
    original, identity, skip_reason), rows of links or of sitemaps, skipped ones too."""
    keyed = seen.select(record_key(F.col("identity"), F.col("original")).alias("key"), "order", "original", "identity", "skip_reason")
    first = keyed.groupBy("key").agg(F.min_by(F.struct("original", "identity", "skip_reason"), F.struct("order", "original")).alias("r"))
    return first.select("key", "r.*")


def discover(pages: DataFrame, exclusion: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(links, offers) of pages (identity, depth, links): every link as it was seen, left-out ones too, and what they offer
    to the crawl, one click deeper. exclusion gives a profile's reason to leave an address out."""
    return discover_links(pages.select("identity", "depth", F.posexplode("links").alias("seq", "link")).select("identity", "depth", "seq", "link.href"), exclusion)


def discover_links(rows: DataFrame, exclusion: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """As discover(), of links (identity, depth, seq, href), and target where the resolved addresses are at hand."""
    rows = rows.withColumnRenamed("identity", "from_identity")
    target = F.col("target") if "target" in rows.columns else U.resolve_of(F.col("from_identity"), F.col("href"))
    seen = rows.select("from_identity", "depth", "seq", U.classify_href(F.col("from_identity"), F.col("href"), exclusion(target), target).alias("c"))
    links = seen.select(F.struct("from_identity", "seq").alias("order"), "from_identity", "c.original", "c.identity", "c.skip_reason")
    offers = seen.where("c.identity is not null").select("c.identity", "c.original", (F.col("depth") + 1).alias("depth"), F.lit(True).alias("via_website"), F.lit(False).alias("via_sitemap"), "c.skip_reason")
    return links, offers


def slots_used(records: DataFrame) -> DataFrame:
    """One row, n: the records that take a place under the cap on URLs."""
    return records.agg(F.count_if(F.col("state").isin("fetched", "failed", "in_flight") | queued()).alias("n"))


def reclassify_queued(records: DataFrame, state: str, reason: str) -> DataFrame:
    """records, of which those that wait get another state and the reason for it."""
    waits = queued()
    return records.withColumns({"state": F.when(waits, state).otherwise(F.col("state")), "reason": F.when(waits, reason).otherwise(F.col("reason"))})


def resume(records: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, frontier (position, identity)) to go on with after a stop: what was in flight waits again, and the
    frontier has every waiting record once: first as it was, then what was in flight, then the others, by key."""
    again = records.withColumn("_again", F.col("state") == "in_flight")
    again = again.withColumns({"state": F.when(F.col("_again"), "pending").otherwise(F.col("state")), "reason": F.when(F.col("_again"), QUEUED).otherwise(F.col("reason"))})
    waits = again.where(queued() & F.col("identity").isNotNull()).groupBy("identity").agg(F.bool_or("_again").alias("_again"))
    places = [
        frontier.select(F.lit(0).alias("kind"), F.col("position").cast("long").alias("at"), "identity"),
        waits.select(F.when(F.col("_again"), 1).otherwise(2).alias("kind"), F.lit(0).cast("long").alias("at"), "identity"),
    ]
    first = reduce(DataFrame.unionByName, places).groupBy("identity").agg(F.min(F.struct("kind", "at")).alias("p"))
    kept = first.join(waits.select("identity"), "identity", "left_semi").select("p.kind", "p.at", "identity")
    return again.drop("_again"), ranked(kept, ["kind", "at", "identity"], "position").select("position", "identity")


def backoff(attempt: Column, retry_after: Column, longest: int = LONGEST) -> Column:
    """Seconds to wait after a try (from 0): what the server asks for, else a doubling wait, at most `longest`."""
    doubled = F.pow(F.lit(2.0), F.least(attempt, F.lit(DOUBLINGS))).cast("long")
    return F.least(F.coalesce(retry_after.cast("long"), doubled), F.lit(longest).cast("long"))


def after_failures(tries: DataFrame, retries: int = RETRIES) -> DataFrame:
    """(identity, next, wait) of failed tries (identity, attempt, retryable, denied, retry_after): the last try of an
    address decides; a refused signature stops the run, a failure that can pass is tried again while tries are left."""
    last = tries.groupBy("identity").agg(F.max_by(F.struct("attempt", "retryable", "denied", "retry_after"), "attempt").alias("t")).select("identity", "t.*")
    what = F.when(F.col("denied"), "stop").when(F.col("retryable") & (F.col("attempt") < retries), "retry").otherwise("failed")
    return last.select("identity", what.alias("next"), F.when(what == "retry", backoff(F.col("attempt"), F.col("retry_after"))).alias("wait"))
