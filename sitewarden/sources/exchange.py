"""Exports of a report (CSV, JSON, Parquet) and import of baseline tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.functions.text import neutralise_formula
from sitewarden.plans import catalogue
from sitewarden.plans.engine import Report

#: Parts of credentials that must not leave in an export.
SECRETS = ("signature-input", "signature-agent", "authorization:", "bearer ")
REQUIRED = ("source_check", "entity_url")
OPTIONAL = ("referrer", "unit", "severity", "observed_at", "report", "current", "new_issues", "row_kind")


def coverage_row(urls: DataFrame) -> DataFrame:
    """One row: how many URL records are in each state, and all."""
    states = ("fetched", "excluded", "blocked", "failed", "pending", "in_flight")
    return urls.agg(*(F.count_if(F.col("state") == s).cast("long").alias(s) for s in states), F.count("*").alias("discovered"))


def export_rows(report: Report, urls: DataFrame, run_id: int) -> DataFrame:
    """The flat form of the findings: rule, entity, texts, evidence as one string, and the run's coverage on each row."""
    points = F.array_join(F.transform("evidence", lambda e: F.concat(e["observation_identity"], F.lit("#"), e["field"], F.lit(": "), e["excerpt"])), " | ")
    units = F.create_map(*(F.lit(x) for r in catalogue.RULES.values() for x in (r.id, r.unit)))
    rows = report.findings.select(F.lit(run_id).cast("long").alias("run_id"), "rule_id", "entity_key", "severity", F.coalesce(units[F.col("rule_id")], F.lit("unspecified")).alias("unit"), "state", "suppressed", "fact", "recommendation", points.alias("evidence"), "config_version", "catalogue_version")
    return rows.join(F.broadcast(coverage_row(urls)))


def _guard(rows: DataFrame) -> None:
    text = F.lower(F.concat_ws(" ", *(c for c, kind in rows.dtypes if kind == "string")))
    test = F.lit(False)
    for secret in SECRETS:
        test = test | F.contains(text, F.lit(secret))
    if not rows.where(test).isEmpty():
        raise ValueError("the export would carry credentials")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; text that a spreadsheet would evaluate gets a quote before it."""
    _guard(rows)
    rows.select(*(neutralise_formula(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes)).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(report: Report, urls: DataFrame, run_id: int, path: str) -> None:
    """Findings as JSON lines in `findings`, outcomes in `outcomes`, the coverage in `coverage`: nothing is gathered."""
    _guard(report.findings.select("entity_key", "fact", "recommendation", F.to_json("evidence").alias("e")))
    report.findings.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").json(f"{path}/findings")
    report.outcomes.coalesce(1).write.mode("errorifexists").json(f"{path}/outcomes")
    coverage_row(urls).coalesce(1).write.mode("errorifexists").json(f"{path}/coverage")


def document(report: Report, urls: DataFrame, run_id: int, limit: int = 10_000) -> str:
    """The export as one JSON text, for reports of at most `limit` findings."""
    rows = report.findings.orderBy("rule_id", "entity_key").limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} findings; write_json() has no limit")
    outcomes = [{"rule_id": r, "state": s} for r, s in sorted(report.states.items())]
    return json.dumps({"run_id": run_id, "coverage": coverage_row(urls).first().asDict(), "findings": [json.loads(r) for r in rows], "outcomes": outcomes}, indent=2, ensure_ascii=False)


@dataclass(frozen=True)
class FieldMap:
    """Names of a baseline's columns, lower case."""

    source_check: str = "check"
    entity_url: str = "url"
    referrer: str = "referrer"
    unit: str = "unit"
    severity: str = "severity"
    observed_at: str = "observed at"
    report: str = "report"
    current: str = "current"
    new_issues: str = "new issues"
    row_kind: str = "row kind"


def read_baseline(spark: SparkSession, path: str, fields: FieldMap | None = None) -> DataFrame:
    """Rows of a baseline CSV by FieldMap; other columns in the map `unmatched`; numbers that can't be read are null."""
    if path.lower().endswith((".xlsx", ".xls")):
        raise ValueError("workbooks aren't read; export the sheet as CSV")
    fields = fields or FieldMap()
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    wanted = {k: names.get(getattr(fields, k)) for k in (*REQUIRED, *OPTIONAL)}
    if missing := [getattr(fields, k) for k in REQUIRED if wanted[k] is None]:
        raise ValueError(f"the baseline lacks the columns {', '.join(missing)}")
    col = lambda k: F.col(f"`{wanted[k]}`") if wanted[k] else F.lit(None).cast("string")
    rest = [c for c in raw.columns if c not in wanted.values()]
    unmatched = F.map_from_arrays(F.array(*(F.lit(c.strip()) for c in rest)), F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rest))) if rest else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    kind = F.when(F.lower(F.trim(col("row_kind"))).startswith("aggregate") | (F.coalesce(F.trim(col("entity_url")), F.lit("")) == ""), "aggregate").otherwise("entity")
    rows = raw.select(*(F.trim(col(k)).alias(k) for k in ("source_check", "entity_url", "referrer", "unit", "severity", "observed_at", "report")), col("current").try_cast("long").alias("current"), col("new_issues").try_cast("long").alias("new_issues"), kind.alias("row_kind"), unmatched.alias("unmatched"))
    return rows.where("coalesce(source_check, '') <> ''")
