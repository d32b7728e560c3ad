"""Entry points over stored runs and raw responses: audits of what a store has, comparison of two runs, and the way from
responses to findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sitewarden.functions import html
from sitewarden.operators import algebra
from sitewarden.operators.evidence import Evidence
from sitewarden.plans import engine, history
from sitewarden.plans.config import AuditConfig, Profile
from sitewarden.sources.store import Store


@dataclass
class LoadedRun:
    """A run as it was stored: its row, its evidence and its report; tables that it has nothing in are empty."""

    run_id: int
    profile: Profile
    status: str
    completed: bool
    cancelled: bool
    error: str | None
    catalogue_version: int
    config_version: int
    evidence: Evidence
    frontier: DataFrame
    outcomes: DataFrame
    findings: DataFrame
    suppressions: DataFrame

    def view(self) -> history.RunView:
        """The run for a comparison; suppressions count as they are now."""
        findings = algebra.mark_suppressed(self.findings.drop("suppressed"), self.suppressions)
        return history.RunView(self.run_id, findings, self.outcomes, self.evidence.urls, self.profile, self.completed, self.cancelled, self.catalogue_version, self.config_version)


def load_run(store: Store, run_id: int, now: int = 0) -> LoadedRun:
    """The run of that number; KeyError if there is none. Reads only the run's partitions."""
    rows = store.read("runs", run_id).limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"no run {run_id}")
    row = rows[0]
    part = lambda name: store.read(name, run_id).drop("run_id")
    profile = Profile.read(row["profile"])
    evidence = Evidence(
        store.spark, part("observations"), urls=part("url_records"), sitemap_files=part("sitemap_files"), sitemap_urls=part("sitemap_urls"),
        sitemap_known=True, sitemap_done=bool(row["sitemap_done"]), robots=part("robots_runs"), resource_fetches=part("resource_fetches"),
        tls_inspections=part("tls_inspections"), host_probes=part("host_probes"), start_url=row["start_url"] or profile.start_url, now=now,
    )
    return LoadedRun(
        run_id, profile, row["status"], bool(row["completed"]), bool(row["cancelled"]), row["error"], row["catalogue_version"] or 1, row["config_version"] or 1,
        evidence, part("frontier"), part("rule_outcomes"), part("findings"), store.active_suppressions(run_id),
    )


def evaluate_stored(store: Store, run_id: int, config: AuditConfig | None = None, registry: engine.Registry | None = None, now: int = 0) -> engine.Report:
    """Evaluate a stored run, keep the report in the store and return it."""
    run = load_run(store, run_id, now)
    report = engine.evaluate(run.evidence, config, registry, run.suppressions)
    store.persist_report(run_id, report, now)
    run.evidence.close()  # findings come from drafts that were written
    return report


def compare_stored(store: Store, baseline_id: int, later_id: int) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(deltas, notes) of two stored runs and the reports that they have."""
    baseline, later = load_run(store, baseline_id).view(), load_run(store, later_id).view()
    return history.compare_runs(baseline, later), history.compatibility_notes(baseline, later)


def audit_responses(responses: DataFrame, start_url: str | None = None, config: AuditConfig | None = None, rules=None, now: int = 0, repeats: bool = False) -> engine.Report:
    """From raw responses to findings: extraction and the rules on what was extracted. repeats: responses may share an
    address, and each has its own findings."""
    return engine.evaluate(Evidence(responses.sparkSession, html.observations(responses), start_url=start_url, now=now), config, rules=rules, repeats=repeats)
