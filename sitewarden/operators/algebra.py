"""The algebra of rules: drafts and gates over shared relations, states, suppressions and the final findings.

A rule is a predicate over a relation with expressions for what it reports. All rules of one relation are evaluated
together: one projection yields the drafts of all of them, one aggregation their gates, so a table is scanned once
however many rules read it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden import schemas

DRAFT = f"rule_id string, entity_key string, fact string, recommendation string, evidence {schemas.EVIDENCE}, ord string"
GATE = "rule_id string, applicable boolean, complete boolean"


@dataclass(frozen=True)
class Spec:
    """A rule over a relation. `scope`: the rows that make it applicable (all if None). `unknown`: rows, within the
    scope, whose evidence is missing, any of which makes the rule incomplete."""

    rule_id: str
    where: Column
    entity: Column
    fact: Column
    recommendation: str
    evidence: list[Column]
    scope: Column | None = None
    unknown: Column | None = None
    ord: Column | None = None
    depends_on: tuple[str, ...] = ()


@dataclass
class Output:
    """What rules give: gates, a row a rule, and drafts."""

    gates: list[DataFrame] = field(default_factory=list)
    drafts: list[DataFrame] = field(default_factory=list)


def draft_struct(rule_id: str, entity: Column, fact: Column, recommendation, evidence: Column, order: Column | None = None) -> Column:
    recommendation = recommendation if isinstance(recommendation, Column) else F.lit(recommendation)
    return F.struct(F.lit(rule_id).alias("rule_id"), entity.cast("string").alias("entity_key"), fact.alias("fact"), recommendation.alias("recommendation"), evidence.alias("evidence"), F.coalesce(order if order is not None else entity, F.lit("")).cast("string").alias("ord"))


def evaluate_specs(rows: DataFrame, specs: list[Spec], counts: DataFrame, least: str) -> Output:
    """Drafts and gates of rules over one relation. counts is one row; a rule is incomplete while its column `least`
    is 0, then not applicable without a row in scope, then incomplete with an unknown row in scope."""
    if not specs:
        return Output()

    def cleaned(c: Column | None, default: bool) -> Column:
        return F.lit(default) if c is None else F.coalesce(c, F.lit(False))

    found = F.array(*(F.when(cleaned(s.scope, True) & cleaned(s.where, False), draft_struct(s.rule_id, s.entity, s.fact, s.recommendation, F.array(*s.evidence), s.ord)) for s in specs))
    # what a lone rule finds is known before joins and Python functions take the rows up
    hits = rows.where(cleaned(specs[0].scope, True) & cleaned(specs[0].where, False)) if len(specs) == 1 else rows
    drafts = hits.select(F.inline(F.array_compact(found)))
    sums = [F.coalesce(F.bool_or(cleaned(s.scope, True)), F.lit(False)).alias(f"s{i}") for i, s in enumerate(specs)]
    sums += [F.coalesce(F.bool_or(cleaned(s.scope, True) & cleaned(s.unknown, False)), F.lit(False)).alias(f"u{i}") for i, s in enumerate(specs)]
    # only rows in scope count for the gate of a lone rule
    scoped = rows.where(cleaned(specs[0].scope, True)) if len(specs) == 1 else rows
    one = scoped.agg(*sums).join(F.broadcast(counts))
    enough = F.col(least) > 0
    gates = F.array(*(F.struct(F.lit(s.rule_id).alias("rule_id"), ((~enough) | F.col(f"s{i}") | F.lit(s.scope is None)).alias("applicable"), (enough & ~F.col(f"u{i}")).alias("complete")) for i, s in enumerate(specs)))
    return Output([one.select(F.inline(gates))], [drafts])


def gate_rows(one: DataFrame, rule_id: str, applicable, complete) -> DataFrame:
    """A rule's gate from a relation of one row."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return one.select(F.lit(rule_id).alias("rule_id"), F.coalesce(as_column(applicable), F.lit(False)).alias("applicable"), F.coalesce(as_column(complete), F.lit(False)).alias("complete"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def resolve_state(unsupported: bool, enabled: bool, applicable: bool, complete: bool, findings: bool) -> str:
    """The state of a rule; the first that holds."""
    if unsupported:
        return "unsupported"
    if not enabled:
        return "disabled"
    if not applicable:
        return "not_applicable"
    if not complete:
        return "incomplete"
    return "findings" if findings else "passed"


def blocked_by(states: list[str | None]) -> str | None:
    """What the states of a rule's prerequisites make of it: None if they don't stop it."""
    if any(s in (None, "unsupported") for s in states):
        return "unsupported"
    return "incomplete" if any(s in ("incomplete", "disabled") for s in states) else None


def checker_order(depends_on: dict[str, tuple[str, ...]]) -> list[str]:
    """Rules after their prerequisites, by name where free; prerequisites outside don't count."""
    left = {r: {d for d in deps if d in depends_on} for r, deps in depends_on.items()}
    out: list[str] = []
    while left:
        ready = sorted(r for r, deps in left.items() if not deps)
        if not ready:
            raise ValueError(f"rules depend on each other: {', '.join(sorted(left))}")
        out.append(ready[0])
        del left[ready[0]]
        for deps in left.values():
            deps.discard(ready[0])
    return out


def valid_drafts(drafts: DataFrame) -> DataFrame:
    return drafts.where("entity_key <> '' and fact <> '' and recommendation <> '' and size(evidence) > 0")


def first_per_id(drafts: DataFrame) -> DataFrame:
    """The first draft of each (rule_id, entity_key): an aggregation with partial results, no window."""
    return drafts.groupBy("rule_id", "entity_key").agg(F.min_by(F.struct("fact", "recommendation", "evidence"), "ord").alias("d")).select("rule_id", "entity_key", "d.*")


def mark_suppressed(findings: DataFrame, suppressions: DataFrame | None) -> DataFrame:
    """suppressed: an active suppression names the rule, the entity, or both. Each kind is an equi-join."""
    if suppressions is None:
        return findings.withColumn("suppressed", F.lit(False))
    active = suppressions.where("revoked_at is null").select("rule_id", "entity_key").distinct()
    rules = active.where("rule_id is not null and entity_key is null").select("rule_id").distinct().withColumn("_r", F.lit(True))
    entities = active.where("rule_id is null and entity_key is not null").select("entity_key").distinct().withColumn("_e", F.lit(True))
    pairs = active.where("rule_id is not null and entity_key is not null").withColumn("_p", F.lit(True))
    marked = findings.join(rules, "rule_id", "left").join(entities, "entity_key", "left").join(pairs, ["rule_id", "entity_key"], "left")
    return marked.withColumn("suppressed", F.coalesce("_r", "_e", "_p", F.lit(False))).drop("_r", "_e", "_p")


def affected_identities(findings: DataFrame, rule_id: str) -> DataFrame:
    return findings.where(F.col("rule_id") == rule_id).select(F.explode("evidence.observation_identity").alias("identity")).distinct()
