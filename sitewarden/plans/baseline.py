"""Comparison of an audit with an imported baseline of another tool."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.plans import catalogue, engine
from sitewarden.plans.config import Profile
from sitewarden.plans.history import profile_exclusion

PREREQUISITES = ("catalogue", "crawl", "checkers", "export", "independent_review")


@dataclass
class BaselineRun:
    """Rows of a baseline: (source_check, entity_url, row_kind), its crawl date and user agent, and the audit's."""

    rows: DataFrame
    crawl_date: str | None = None
    user_agent: str | None = None


def url_accounts(urls: DataFrame, baseline: DataFrame, profile: Profile) -> DataFrame:
    """(url, disposition, reason) of every URL record, and baseline addresses that the crawl has no record of."""
    known = urls.select(F.coalesce("identity", "original").alias("url"), F.col("state").alias("disposition"), "reason")
    ids = urls.select(F.explode(F.array("original", "identity")).alias("url")).where("url is not null").distinct()
    only = baseline.where("entity_url is not null and entity_url <> ''").select(F.col("entity_url").alias("url")).distinct().join(ids, "url", "left_anti")
    reason = F.coalesce(profile_exclusion(profile, F.col("url")), F.lit("not found by this crawl"))
    return known.unionByName(only.select("url", F.lit("baseline_only").alias("disposition"), reason.alias("reason")))


def rule_of(checks: DataFrame) -> DataFrame:
    """checks with rule_id: a check's name is a rule's label, in any case, or its id."""
    names = [(n, r.id) for r in catalogue.RULES.values() for n in (r.label.lower(), r.id)]
    known = checks.sparkSession.createDataFrame(names, "_name string, rule_id string")
    return checks.join(F.broadcast(known), F.lower(F.trim("source_check")) == F.col("_name"), "left").drop("_name")


def classify_entities(baseline: DataFrame, findings: DataFrame, urls: DataFrame, profile: Profile, same_date: bool, same_agent: bool) -> DataFrame:
    """(rule_id, entity_url, verdict, reason) of the baseline's affected entities: overlap, explained or unexplained.

    An entity overlaps if a finding of the rule has it as key or inside the key. Equality is an equi-join; containment
    compares, within a rule, only addresses that are a link or group key's parts: keys are split at blanks first."""
    wanted = rule_of(baseline.where("row_kind = 'entity'")).select("rule_id", "entity_url").distinct()
    parts = findings.select("rule_id", F.explode(F.array_distinct(F.concat(F.array("entity_key"), F.split("entity_key", " ")))).alias("entity_url")).distinct().withColumn("hit", F.lit(True))
    states = urls.select(F.explode(F.array_distinct(F.array("original", "identity"))).alias("entity_url"), "state", "reason").where("entity_url is not null")
    states = states.groupBy("entity_url").agg(F.max_by(F.struct("state", "reason"), "state").alias("s"))
    rows = wanted.join(parts, ["rule_id", "entity_url"], "left").join(states, "entity_url", "left")
    why = F.coalesce(
        F.when(F.col("s.state") != "fetched", F.concat(F.lit("in this run: "), F.col("s.state"), F.lit(" "), F.coalesce("s.reason", F.lit("")))),
        F.when(F.col("s").isNull(), profile_exclusion(profile, F.col("entity_url"))),
        F.lit(None if same_date else "the baseline was crawled on another day"),
        F.lit(None if same_agent else "the baseline was crawled by another user agent"),
    )
    verdict = F.when(F.col("hit"), "overlap").when(why.isNotNull(), "explained").otherwise("unexplained")
    return rows.select("rule_id", "entity_url", verdict.alias("verdict"), F.when(F.col("hit").isNull(), why).alias("reason"))


def matrix(report: engine.Report, entities: DataFrame) -> DataFrame:
    """(rule_id, matrix_class, impact) for every rule of the catalogue; the first class that holds."""
    spark = report.findings.sparkSession
    registered = engine.default_registry().families
    rules = catalogue.as_frame(spark, registered)
    counts = report.findings.groupBy("rule_id").agg(F.count("*").alias("found"))
    verdicts = entities.groupBy("rule_id").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("overlap", "explained", "unexplained")))
    rows = F.broadcast(rules).join(report.outcomes, "rule_id", "left").join(counts, "rule_id", "left").join(verdicts, "rule_id", "left")
    kind = (
        F.when(F.col("unexplained") > 0, "entity_miss_unexplained")
        .when(F.col("overlap") > 0, "entity_overlap")
        .when(F.col("explained") > 0, "entity_miss_explained")
        .when(F.col("coverage") == "engine", "engine_covered")
        .when(F.col("coverage").isin("deferred", "specified_unregistered"), "deferred_explained")
        .when((F.col("captured") == 0) & (F.col("state") == "passed"), "passing_regression_pinned")
        .when(F.coalesce("found", F.lit(0)) > 0, "covered")
        .otherwise(F.when(F.coalesce("captured", F.lit(0)) > 0, "aggregate_only").otherwise("covered"))
    )
    impact = F.when((F.col("severity") == "error") | (F.coalesce("captured", F.lit(0)) > 0), "high").otherwise("normal")
    return rows.select("rule_id", kind.alias("matrix_class"), impact.alias("impact"))


def replacement_claim(classes: DataFrame, met: dict[str, bool]) -> str:
    """`claimed` only without unexplained misses and with every prerequisite met; a review is never met by a run."""
    open_ = not classes.where("matrix_class = 'entity_miss_unexplained'").isEmpty()
    return "claimed" if not open_ and all(met.get(p, False) for p in PREREQUISITES) else "not_claimed"
