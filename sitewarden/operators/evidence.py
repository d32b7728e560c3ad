"""The evidence of a run and the relations that rules share: each is built once, from one scan of its table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden import schemas
from sitewarden.functions import text as T
from sitewarden.functions import urls as U
from sitewarden.sources.tables import drop, materialised

UNSETTLED = ("excluded", "pending", "in_flight")


@dataclass
class Evidence:
    """The inputs that rules may read for one run. Missing tables are empty ones; sitemap is None if never requested.

    Links and resources come as arrays of the observations, or flat: link_rows and resource_rows make relations of a row
    for each (identity, seq and the fields of schemas.LINK or RESOURCE), whatever the arrays hold. They are called when a
    rule asks for them, and what they make is kept. So a page may have more links than fit in one row."""

    spark: SparkSession
    observations: DataFrame
    urls: DataFrame | None = None
    sitemap_files: DataFrame | None = None
    sitemap_urls: DataFrame | None = None
    sitemap_known: bool = False
    sitemap_done: bool = False
    robots: DataFrame | None = None
    resource_fetches: DataFrame | None = None
    tls_inspections: DataFrame | None = None
    host_probes: DataFrame | None = None
    start_url: str | None = None
    now: int = 0
    link_rows: Callable[[], DataFrame] | None = None
    resource_rows: Callable[[], DataFrame] | None = None
    settled: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name, ddl in (("urls", schemas.URL_RECORD), ("sitemap_files", schemas.SITEMAP_FILE), ("sitemap_urls", schemas.SITEMAP_URL), ("robots", schemas.ROBOTS_RUN), ("resource_fetches", schemas.RESOURCE_FETCH), ("tls_inspections", schemas.TLS_INSPECTION), ("host_probes", schemas.HOST_PROBE)):
            if getattr(self, name) is None:
                setattr(self, name, self.spark.createDataFrame([], ddl))

    @cached_property
    def all_links(self) -> DataFrame:
        """(identity, seq and the fields of a link): the links of all pages."""
        if self.link_rows is not None:
            return self.link_rows()
        return self.observations.select("identity", F.posexplode("links").alias("seq", "link")).select("identity", "seq", "link.*")

    @cached_property
    def all_resources(self) -> DataFrame:
        return self.resource_rows()

    def of_complete(self, name: str, keyed: bool = True, where: Column | None = None) -> DataFrame:
        """(identity, page_key, seq, the fields and key, the normalised destination): the links or resources of complete
        pages; without key if it isn't asked for, and flat rows are then read once. where, a condition on the fields, is looked at
        before addresses are."""
        where = F.lit(True) if where is None else where
        if (self.link_rows if name == "links" else self.resource_rows) is None:
            rows = self.complete_pages.select("identity", F.col("key").alias("page_key"), F.posexplode(name).alias("seq", "one"))
            rows = rows.select("identity", "page_key", "seq", "one.*").where(where)
            return rows.withColumn("key", U.identity_of(F.col("destination"))) if keyed else rows
        rows = (self.all_links if name == "links" else self.all_resources).where(where)
        rows = U.with_identity(rows, F.col("destination"), "key", look=name == "resources") if keyed else rows
        flags = F.col("page.flags")
        incomplete = flags["truncated"] | flags["challenge"] | flags["error_status"] | flags["non_html"] | flags["encoding_fallback"]
        complete = self.observations.where(~incomplete).select("identity").distinct().withColumn("page_key", U.identity_of(F.col("identity")))
        return rows.join(complete, "identity").select("identity", "page_key", *(c for c in rows.columns if c != "identity"))

    def counted(self, pages: DataFrame) -> DataFrame:
        """pages with the right n_links, where links are flat."""
        if self.link_rows is None:
            return pages
        counts = self.all_links.groupBy("identity").agg(F.count("*").cast("int").alias("n_links"))
        return pages.drop("n_links").join(counts, "identity", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))

    @cached_property
    def whole_observations(self) -> DataFrame:
        """The observations with all their links and resources as arrays."""
        rows = self.observations
        for name, flat, kind in (("links", self.link_rows and self.all_links, schemas.LINK), ("resources", self.resource_rows and self.all_resources, schemas.RESOURCE)):
            if flat is not None:
                one = F.struct("seq", F.struct(*(c for c in flat.columns if c not in ("identity", "seq"))).cast(kind).alias("v"))
                arrays = flat.groupBy("identity").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["v"]).alias("_all"))
                rows = rows.join(arrays, "identity", "left").withColumn(name, F.coalesce("_all", F.array().cast(f"array<{kind}>"))).drop("_all")
        return rows

    @cached_property
    def url_keys(self) -> DataFrame:
        """One row for each normalised address of the URL records; of equal ones the last by original."""
        keyed = U.with_identity(self.urls, F.coalesce("identity", "original"), "key")
        last = keyed.groupBy("key").agg(F.max_by(F.struct("state", "reason", "click_depth", "identity", "original"), F.struct("original", "state")).alias("r"))
        return last.select("key", "r.state", F.when(F.col("r.state") == "failed", F.col("r.reason")).alias("failed_reason"), "r.click_depth")

    @cached_property
    def crawl_set(self) -> DataFrame:
        fetched = self.urls.where("state = 'fetched' and identity is not null").select("identity")
        return U.with_identity(fetched, F.col("identity"), "key").select("key").distinct().withColumn("crawled", F.lit(True))

    @cached_property
    def has_urls(self) -> bool:
        return not self.urls.isEmpty()

    @cached_property
    def listed(self) -> DataFrame:
        """Addresses that the sitemap lists and that weren't skipped."""
        rows = self.sitemap_urls.where("skip_reason is null").select("identity", "original")
        return U.with_identity(rows, F.coalesce("identity", "original"), "key").select("key").distinct().withColumn("in_sitemap", F.lit(True))

    @cached_property
    def pages(self) -> DataFrame:
        """All observations, flat, with: key, complete, in_crawl, in_sitemap, noindex, canonical_targets."""
        flags = F.col("page.flags")
        complete = ~(flags["truncated"] | flags["challenge"] | flags["error_status"] | flags["non_html"] | flags["encoding_fallback"])
        rows = self.observations.select("identity", "page.*", "links", F.size("links").alias("n_links"), "resources", "redirect_chain", complete.alias("complete"), U.identity_of(F.col("identity")).alias("key"))
        rows = rows.withColumn("header_noindex", T.has_token(F.col("robots_headers"), "noindex")).withColumn("noindex", F.col("header_noindex") | T.has_token(F.col("robots_meta"), "noindex"))
        return self.with_crawl(rows).join(self.listed, "key", "left").withColumn("in_sitemap", F.coalesce("in_sitemap", F.lit(False)))

    def with_crawl(self, rows: DataFrame) -> DataFrame:
        """rows with in_crawl, met on the key."""
        if not self.has_urls:
            return rows.withColumn("in_crawl", F.lit(True))
        return rows.join(self.crawl_set, "key", "left").withColumn("in_crawl", F.coalesce("crawled", F.lit(False))).drop("crawled")

    @cached_property
    def complete_pages(self) -> DataFrame:
        return self.pages.where("complete")

    @cached_property
    def targets(self) -> DataFrame:
        """What is known of an address: URL records and observations met on the key, the observation's status first."""
        seen = self.pages.groupBy("key").agg(F.max_by(F.struct("status", "content_type", "noindex", "identity", "canonicals", "hreflangs"), "identity").alias("o"))
        both = self.url_keys.join(seen, "key", "full_outer")
        return both.select("key", "state", "failed_reason", F.col("o.status").alias("status"), F.col("o.content_type").alias("content_type"), F.col("o.noindex").alias("noindex"), F.col("o").isNotNull().alias("observed"), F.col("o.identity").alias("observed_identity"), F.col("o.canonicals").alias("canonicals"), F.col("o.hreflangs").alias("hreflangs"))

    @cached_property
    def fetches(self) -> DataFrame:
        keyed = U.with_identity(self.resource_fetches, F.col("identity"), "key", look=True)
        return keyed.groupBy("key").agg(F.max_by(F.struct("status", "failed_reason", "challenge", "robots_blocked", "robots_known"), "identity").alias("fetch"))

    @cached_property
    def links(self) -> DataFrame:
        """Links of complete pages by position, with what is known of their targets (t: null if nothing)."""
        rows = self._with_nav(self.of_complete("links"))
        target = self.targets.select("key", F.struct("status", "failed_reason", "content_type").alias("t"))
        return rows.join(target, "key", "left")

    def plain_links(self) -> DataFrame:
        """Like links but for key and t, for rules that don't look at targets: no row meets another table's but its page's."""
        return self.links if "links" in self.settled else self._with_nav(self.of_complete("links", keyed=False))

    def _with_nav(self, rows: DataFrame) -> DataFrame:
        return rows.drop("page_key").withColumn("nav", F.col("host_owner").isin("same_host", "other_host") & F.col("destination").isNotNull())

    @cached_property
    def resources(self) -> DataFrame:
        """Embedded resources of complete pages by position, with their fetch (null if none)."""
        return self._with_fetch(self.of_complete("resources"))

    def resources_where(self, where: Column) -> DataFrame:
        """The resources that a condition on their own fields holds for."""
        return self.resources.where(where) if "resources" in self.settled else self._with_fetch(self.of_complete("resources", where=where))

    def _with_fetch(self, rows: DataFrame) -> DataFrame:
        return rows.drop("page_key").join(self.fetches, "key", "left")

    def settle(self) -> None:
        """Write the shared relations once, as Parquet, for evaluations of many rules: each reader then scans only the
        columns that it needs, and no join is made again."""
        for name in ("pages", "targets", "links", "resources"):
            if name not in self.settled:
                self.__dict__.pop("complete_pages", None)
                self.__dict__[name], self.settled[name] = materialised(getattr(self, name))

    def close(self) -> None:
        """Delete what settle() wrote; the relations are made again if they are asked for."""
        for name, folder in self.settled.items():
            self.__dict__.pop(name, None)
            drop(self.spark, folder)
        self.settled.clear()
        self.__dict__.pop("complete_pages", None)

    @cached_property
    def page_counts(self) -> DataFrame:
        """One row, counted once: n_obs, n_complete."""
        counts = self.observations.select("page.flags").agg(F.count("*").alias("n_obs"), F.count_if(~(F.col("flags.truncated") | F.col("flags.challenge") | F.col("flags.error_status") | F.col("flags.non_html") | F.col("flags.encoding_fallback"))).alias("n_complete"))
        return self.spark.createDataFrame([tuple(counts.first())], counts.schema)


def pointer(identity, name: str, excerpt) -> Column:
    """One evidence pointer."""
    as_column = lambda c: c if isinstance(c, Column) else F.col(c)
    return F.struct(as_column(identity).alias("observation_identity"), F.lit(name).alias("field"), F.coalesce(excerpt if isinstance(excerpt, Column) else F.lit(excerpt), F.lit("")).cast("string").alias("excerpt"))
