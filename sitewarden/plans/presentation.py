"""What a screen shows of a run, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.plans import catalogue
from sitewarden.plans.engine import Report


def containing(rows: DataFrame, line, text: str) -> DataFrame:
    """Rows whose line has the text, in any case; an empty text keeps all."""
    return rows if not text else rows.where(F.contains(F.lower(line), F.lit(text.lower())))


def filtered_urls(urls: DataFrame, text: str = "") -> DataFrame:
    line = F.concat_ws(" ", "original", "state", "reason")
    return containing(urls.select("original", "identity", "state", "reason"), line, text)


def investigation(report: Report) -> DataFrame:
    """Findings by severity and rule, with the rule's label."""
    labels = F.create_map(*(F.lit(x) for r in catalogue.RULES.values() for x in (r.id, r.label)))
    rows = report.findings.groupBy("severity", "rule_id").agg(F.count("*").alias("findings"), F.count_if("suppressed").alias("suppressed"))
    return rows.select("severity", "rule_id", labels[F.col("rule_id")].alias("label"), "findings", "suppressed")


def unsettled(report: Report) -> DataFrame:
    """Rules without a verdict."""
    return report.outcomes.where("state in ('incomplete', 'unsupported')")


def inlinks(links: DataFrame, address: str) -> DataFrame:
    """Links to an address, by what is written or what it resolves to."""
    return links.where((F.col("href") == address) | (F.col("destination") == address)).select("source", "href", "anchor")
