"""Comparison of two runs: what became of each finding, groups of related ones, and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import urls as U
from sitewarden.plans.config import Profile


@dataclass
class RunView:
    """A run as compare_runs() sees it: findings, outcomes and URL records."""

    run_id: int
    findings: DataFrame
    outcomes: DataFrame
    urls: DataFrame
    profile: Profile
    completed: bool = True
    cancelled: bool = False
    catalogue_version: int = 1
    config_version: int = 1


def later_run_incomplete(run: RunView) -> bool:
    return not run.completed or run.cancelled or not run.urls.where("state in ('pending', 'in_flight')").isEmpty()


def _identities(findings: DataFrame) -> DataFrame:
    """(rule_id, entity_key, id): the addresses that a finding is about."""
    return findings.select("rule_id", "entity_key", F.explode(F.array_distinct(F.concat(F.array("entity_key"), F.col("evidence.observation_identity")))).alias("id"))


def profile_exclusion(profile: Profile, url: Column) -> Column:
    start = U.parse(profile.start_url)
    origin = f"{start.scheme}://{start.host}" + (f":{start.port}" if start.port else "")
    ignored = list(profile.ignored_parameters) if profile.ignored_parameter_mode == "skip" else []
    return U.exclusion(url, origin, list(profile.allowed_subfolders), list(profile.excluded_paths), ignored, profile.case_sensitive_parameters)


def compare_runs(baseline: RunView, later: RunView) -> DataFrame:
    """(rule_id, entity_key, change, severity, fact, evidence) for each finding of either run; the later run's words
    where it has the finding. Addresses meet URL records in equi-joins on the original and on the identity."""
    old = baseline.findings.select("rule_id", "entity_key", F.struct("severity", "fact", "evidence").alias("old"))
    new = later.findings.select("rule_id", "entity_key", F.struct("severity", "fact", "evidence", "suppressed").alias("new"))
    both = old.join(new, ["rule_id", "entity_key"], "full_outer")
    gone = old.join(new, ["rule_id", "entity_key"], "left_anti").select("rule_id", "entity_key", "old.evidence")
    ids = _identities(gone)
    records = later.urls.select(F.explode(F.array_distinct(F.array("original", "identity"))).alias("id"), "state").where("id is not null").distinct()
    excluded = F.col("id").rlike("^https?://") & profile_exclusion(later.profile, F.col("id")).isNotNull()
    seen = ids.join(records, "id", "left").groupBy("rule_id", "entity_key").agg(
        F.coalesce(F.bool_or(F.col("state") == "fetched"), F.lit(False)).alias("fetched"),
        F.coalesce(F.bool_or(F.col("state").isin("excluded", "blocked")), F.lit(False)).alias("left_out"),
        F.count("state").alias("records"),
        F.coalesce(F.bool_or(excluded), F.lit(False)).alias("outside"),
    )
    settled = later.outcomes.select("rule_id", F.col("state").isin("passed", "findings", "not_applicable").alias("settled"))
    rows = both.join(seen, ["rule_id", "entity_key"], "left").join(settled, "rule_id", "left")
    out_of_scope = F.when(F.col("records") > 0, F.col("left_out")).otherwise(F.col("outside"))
    rechecked = F.col("fetched") & F.coalesce("settled", F.lit(False))
    change = (
        F.when(F.col("new").isNotNull() & F.col("new.suppressed"), "suppressed")
        .when(F.col("new").isNotNull() & F.col("old").isNotNull(), "persistent")
        .when(F.col("new").isNotNull(), "new")
        .when(out_of_scope, "out_of_scope")
        .when(~F.coalesce(rechecked, F.lit(False)), "not_rechecked")
        .otherwise("resolved")
    )
    pick = lambda name: F.coalesce(f"new.{name}", f"old.{name}").alias(name)
    return rows.select("rule_id", "entity_key", change.alias("change"), pick("severity"), pick("fact"), pick("evidence"))


def group_issues(deltas: DataFrame) -> DataFrame:
    """(kind, rule_id, key, n): resources (a finding about two pages or more) and templates (findings of a rule whose
    first evidence says the same)."""
    pages = F.size(F.array_distinct(F.col("evidence.observation_identity")))
    resources = deltas.where(pages > 1).select(F.lit("resource").alias("kind"), "rule_id", F.col("entity_key").alias("key"), pages.cast("long").alias("n"))
    said = F.try_element_at("evidence", F.lit(1))["excerpt"]
    templates = deltas.where(F.coalesce(said, F.lit("")) != "").groupBy("rule_id", said.alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return resources.unionByName(templates.select(F.lit("template").alias("kind"), "rule_id", "key", "n"))


def summarize(deltas: DataFrame) -> DataFrame:
    """One row of counts by change, and how many findings of the baseline were looked at again."""
    kinds = ("new", "persistent", "resolved", "suppressed", "out_of_scope", "not_rechecked")
    again = F.col("change").isin("persistent", "resolved", "suppressed")
    return deltas.agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds), F.count_if(again).alias("rechecked_baseline"), F.count("*").alias("total"))


def compatibility_notes(baseline: RunView, later: RunView) -> list[tuple[str, str]]:
    """(kind, note) for each way in which the runs can't be compared fairly."""
    a, b = baseline.profile, later.profile
    out = []
    if baseline.catalogue_version != later.catalogue_version:
        out.append(("catalogue_version", f"{baseline.catalogue_version} and {later.catalogue_version}"))
    if baseline.config_version != later.config_version:
        out.append(("rule_config_version", f"{baseline.config_version} and {later.config_version}"))
    if (a.allowed_subfolders, a.excluded_paths) != (b.allowed_subfolders, b.excluded_paths):
        out.append(("exclusions", "the folders differ"))
    if (a.ignored_parameters, a.ignored_parameter_mode) != (b.ignored_parameters, b.ignored_parameter_mode):
        out.append(("skip_parameters", "the ignored parameters differ"))
    if later_run_incomplete(later):
        out.append(("incomplete_later_run", "the later run isn't complete"))
    if a.start_url != b.start_url:
        out.append(("start_url", f"{a.start_url} and {b.start_url}"))
    return out


def change_of(deltas: DataFrame, rule_id: str, entity_key: str) -> str | None:
    """What became of one finding; None if neither run has it."""
    found = deltas.where((F.col("rule_id") == rule_id) & (F.col("entity_key") == entity_key)).select("change").first()
    return found[0] if found else None


def summary_lines(deltas: DataFrame) -> list[str]:
    """The counts by change as lines, and how much of the baseline was looked at again."""
    row = summarize(deltas).first().asDict()
    again, total = row.pop("rechecked_baseline"), row.pop("total")
    return [f"{kind.replace('_', ' ')}: {n}" for kind, n in row.items()] + [f"looked at again: {again} of the baseline's findings", f"findings in either run: {total}"]
