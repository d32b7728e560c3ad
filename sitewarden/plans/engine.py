"""Evaluation of the catalogue over the evidence of a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.operators import algebra
from sitewarden.operators.algebra import Output
from sitewarden.operators.evidence import Evidence
from sitewarden.plans import catalogue, content_rules, https_rules, index_rules, language_rules, link_rules, page_rules
from sitewarden.plans.config import AuditConfig
from sitewarden.sources.tables import checkpoint

#: Evaluations of more rules than this write the relations that they share first.
MANY = 12
Family = Callable[[Evidence, AuditConfig, set[str]], list[Output]]


class Registry:
    """Rules by id, each with the family that evaluates it and its prerequisites. The last registration wins."""

    def __init__(self):
        self.families: dict[str, Family] = {}
        self.depends_on: dict[str, tuple[str, ...]] = {}

    def register(self, rule_id: str, family: Family, depends_on: tuple[str, ...] = ()) -> None:
        self.families[rule_id] = family
        self.depends_on[rule_id] = depends_on

    def with_prerequisites(self, rules) -> set[str]:
        wanted, more = set(), list(rules)
        while more:
            rule = more.pop()
            if rule in self.families and rule not in wanted:
                wanted.add(rule)
                more += self.depends_on[rule]
        return wanted


def default_registry() -> Registry:
    registry = Registry()
    for module in (page_rules, link_rules, index_rules, language_rules, https_rules, content_rules):
        for rule in module.RULES:
            registry.register(rule, module.evaluate, page_rules.DEPENDS.get(rule, ()))
    return registry


@dataclass
class Report:
    """outcomes (rule_id, state) and findings; the states are also at hand as a dict."""

    outcomes: DataFrame
    findings: DataFrame
    states: dict[str, str]
    config_version: int
    config_fingerprint: str


def evaluate(ev: Evidence, config: AuditConfig | None = None, registry: Registry | None = None, suppressions: DataFrame | None = None, rules=None, repeats: bool = False) -> Report:
    """Evaluate all rules (or the given ones with their prerequisites).

    Drafts of all rules are written once; what comes to the driver is a gate and a count for each rule. A rule's
    findings are released only if its state is `findings`: one missing piece of evidence holds all of them back. Of the
    drafts of one rule and entity the first counts, or with repeats each."""
    config, registry = config or AuditConfig(), registry or default_registry()
    wanted = registry.with_prerequisites(rules if rules is not None else registry.families)
    if len(wanted) > MANY:
        ev.settle()
    families = list(dict.fromkeys(registry.families[r] for r in sorted(wanted)))
    outputs = [o for family in families for o in family(ev, config, {r for r in wanted if registry.families[r] is family})]
    spark = ev.spark
    gates = algebra.union([spark.createDataFrame([], algebra.GATE), *(g for o in outputs for g in o.gates)])
    drafts = algebra.union([spark.createDataFrame([], algebra.DRAFT), *(d.select("rule_id", "entity_key", "fact", "recommendation", "evidence", "ord") for o in outputs for d in o.drafts)])
    drafts = checkpoint(algebra.valid_drafts(drafts).where(F.col("rule_id").isin(*wanted)))
    found = {r["rule_id"] for r in drafts.select("rule_id").distinct().collect()}
    gate = {r["rule_id"]: r for r in gates.collect()}
    states: dict[str, str] = {}
    for rule in algebra.checker_order({r: registry.depends_on[r] for r in wanted}):
        stopped = algebra.blocked_by([states.get(d) for d in registry.depends_on[rule]])
        states[rule] = stopped or algebra.resolve_state(rule not in gate, config.is_enabled(rule), bool(gate.get(rule) and gate[rule]["applicable"]), bool(gate.get(rule) and gate[rule]["complete"]), rule in found)
    if rules is None:
        states |= {r: "unsupported" for r in catalogue.RULES if r not in states}
    released = [r for r, s in states.items() if s == "findings"]
    kept = drafts.where(F.col("rule_id").isin(*released)) if released else drafts.limit(0)
    kept = kept if repeats else algebra.first_per_id(kept)
    severity = F.create_map(*(F.lit(x) for r in catalogue.RULES.values() for x in (r.id, r.severity)))
    cut = F.transform("evidence", lambda e: F.struct(e["observation_identity"].alias("observation_identity"), e["field"].alias("field"), F.substring(e["excerpt"], 1, 240).alias("excerpt")))
    findings = kept.select("rule_id", "entity_key", F.coalesce(severity[F.col("rule_id")], F.lit("notice")).alias("severity"), F.lit("findings").alias("state"), "fact", "recommendation", cut.alias("evidence"), F.lit(config.version).alias("config_version"), F.lit(catalogue.VERSION).alias("catalogue_version"))
    outcomes = spark.createDataFrame(sorted(states.items()), "rule_id string, state string")
    return Report(outcomes, algebra.mark_suppressed(findings, suppressions), states, config.version, config.fingerprint())


def rows_of(report: Report, rules=None) -> DataFrame:
    """A flat view: (rule_id, state, entity_key, evidence) with a row for each finding, and one without an entity for
    each rule that has none. evidence is `identity#field: excerpt`, joined."""
    points = F.array_join(F.transform("evidence", lambda e: F.concat(e["observation_identity"], F.lit("#"), e["field"], F.lit(": "), e["excerpt"])), " | ")
    findings = report.findings.select("rule_id", "state", "entity_key", points.alias("evidence"))
    # no join on rule_id: all findings of a rule would meet in one task. A rule has findings if its state says so
    none = F.lit(None).cast("string")
    alone = report.outcomes.where("state <> 'findings'").select("rule_id", "state", none.alias("entity_key"), none.alias("evidence"))
    rows = findings.unionByName(alone)
    return rows if rules is None else rows.where(F.col("rule_id").isin(*rules))
