"""Runs as Parquet tables partitioned by run_id: replacing writes, upserts, settings, suppressions, retention, listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewarden import schemas
from sitewarden.plans.engine import Report

TABLES = {
    "runs": schemas.RUN, "observations": schemas.OBSERVATION, "url_records": schemas.URL_RECORD, "sitemap_files": schemas.SITEMAP_FILE,
    "sitemap_urls": schemas.SITEMAP_URL, "robots_runs": schemas.ROBOTS_RUN, "resource_fetches": schemas.RESOURCE_FETCH,
    "tls_inspections": schemas.TLS_INSPECTION, "host_probes": schemas.HOST_PROBE, "findings": schemas.FINDING,
    "rule_outcomes": "rule_id string, state string, config_version int", "suppressions": schemas.SUPPRESSION,
    "suppression_events": "suppression_id bigint, action string, reason string, at bigint",
    "audit_evaluations": "seq bigint, evaluated_at bigint, config_version int, config_fingerprint string",
    "frontier": "position bigint, identity string", "store_settings": "key string, value string, version bigint",
    "raw_pages": "identity string, body binary, seq bigint",
}


@dataclass
class Store:
    """A folder with a table in each subfolder."""

    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        if name not in TABLES:
            raise KeyError(name)
        return f"{self.folder}/{name}"

    def read(self, name: str, run_id: int | None = None) -> DataFrame:
        ddl = TABLES[name] if "run_id" in TABLES[name].split() else f"{TABLES[name]}, run_id bigint"
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(name))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ddl)
        rows = self.spark.read.schema(ddl).parquet(self._path(name))
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)

    def replace(self, name: str, run_id: int, rows: DataFrame) -> None:
        """Replace a run's rows; other runs' files aren't touched."""
        rows = rows.withColumn("run_id", F.lit(run_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self._path(name))

    def append(self, name: str, run_id: int, rows: DataFrame) -> None:
        rows.withColumn("run_id", F.lit(run_id).cast("long")).write.mode("append").partitionBy("run_id").parquet(self._path(name))

    def upsert(self, name: str, run_id: int, rows: DataFrame, key: list[str], version: str) -> None:
        """Keep the row of the highest version for each key."""
        from sitewarden.sources.tables import checkpoint

        merged = latest(self.read(name, run_id).drop("run_id").unionByName(rows), key, version)
        self.replace(name, run_id, checkpoint(merged))

    def append_in_order(self, name: str, run_id: int, rows: DataFrame, order: list[str]) -> None:
        """Append rows whose seq goes on from the largest that the run has, in the order of the columns."""
        from sitewarden.sources.tables import ranked

        last = self.read(name, run_id).agg(F.max("seq")).first()[0]
        self.append(name, run_id, ranked(rows, order, "seq").withColumn("seq", F.col("seq") + F.lit(0 if last is None else last + 1)))

    def html_body(self, run_id: int, identity: str) -> bytes | None:
        """The body that was stored last for an address."""
        found = self.read("raw_pages", run_id).where(F.col("identity") == identity).agg(F.max_by("body", "seq")).first()[0]
        return None if found is None else bytes(found)

    def begin(self, run_id: int, profile: str, start_url: str, now: int) -> None:
        """A new run; ValueError if there is one of that number, or one that is running."""
        if not self.read("runs").where((F.col("run_id") == run_id) | (F.col("status") == "running")).isEmpty():
            raise ValueError(f"run {run_id} exists, or a run is going on")
        row = (profile, start_url, "running", False, False, None, False, now, now, 1, 1)
        self.replace("runs", run_id, self.spark.createDataFrame([row], schemas.RUN.replace("run_id bigint, ", "")))

    def _change(self, run_id: int, **values) -> None:
        from sitewarden.sources.tables import checkpoint

        row = self.read("runs", run_id)
        if row.isEmpty():
            raise KeyError(f"no run {run_id}")
        self.replace("runs", run_id, checkpoint(row.drop("run_id").withColumns({k: F.lit(v).cast(row.schema[k].dataType) for k, v in values.items()})))

    def mark_sitemap_done(self, run_id: int, now: int) -> None:
        self._change(run_id, sitemap_done=True, updated_at=now)

    def mark_incomplete(self, run_id: int, error: str | None, now: int) -> None:
        self._change(run_id, status="incomplete", completed=False, error=error, updated_at=now)

    def finish(self, run_id: int, completed: bool, cancelled: bool, error: str | None, now: int) -> None:
        status = "completed" if completed and not cancelled else "failed" if error else "incomplete"
        self._change(run_id, status=status, completed=completed, cancelled=cancelled, error=error, updated_at=now)

    def backup(self, folder: str) -> None:
        """A copy of every table in a folder that must not exist."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            raise ValueError(f"{folder} exists")
        for name in TABLES:
            if not (rows := self.read(name)).isEmpty():
                rows.write.partitionBy("run_id").parquet(f"{folder}/{name}")

    def persist_report(self, run_id: int, report: Report, now: int) -> None:
        """Replace the run's findings and outcomes, and add an evaluation."""
        self.replace("findings", run_id, report.findings)
        self.replace("rule_outcomes", run_id, report.outcomes.withColumn("config_version", F.lit(report.config_version)))
        seq = (self.read("audit_evaluations", run_id).agg(F.max("seq")).first()[0] or 0) + 1
        self.append("audit_evaluations", run_id, self.spark.createDataFrame([(seq, now, report.config_version, report.config_fingerprint)], TABLES["audit_evaluations"]))

    def suppress(self, run_id: int, rule_id: str | None, entity_key: str | None, reason: str, now: int) -> int:
        if not reason.strip():
            raise ValueError("a suppression needs a reason")
        if not rule_id and not entity_key:
            raise ValueError("a suppression names a rule or an entity")
        number = (self.read("suppression_events").agg(F.max("suppression_id")).first()[0] or 0) + 1
        row = (number, run_id, rule_id, entity_key, reason, now, None)
        self.append("suppressions", run_id, self.spark.createDataFrame([row], schemas.SUPPRESSION).drop("run_id"))
        self.append("suppression_events", run_id, self.spark.createDataFrame([(number, "apply", reason, now)], TABLES["suppression_events"]))
        return number

    def revoke(self, run_id: int, number: int, reason: str, now: int) -> None:
        """Revocations are events too; a suppression is active while its last event is `apply`."""
        if self.active_suppressions(run_id).where(F.col("id") == number).isEmpty():
            raise ValueError(f"no active suppression {number}")
        self.append("suppression_events", run_id, self.spark.createDataFrame([(number, "revoke", reason, now)], TABLES["suppression_events"]))

    def active_suppressions(self, run_id: int) -> DataFrame:
        last = self.read("suppression_events", run_id).groupBy("suppression_id").agg(F.max_by("action", F.struct("at", "action")).alias("last"))
        active = last.where("last = 'apply'").select(F.col("suppression_id").alias("id"))
        return self.read("suppressions", run_id).join(active, "id", "left_semi")


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key: an aggregation, no window."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), version).alias("_r")).select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in others)).select(*rows.columns)


def list_runs(runs: DataFrame, urls: DataFrame) -> DataFrame:
    """Runs with the number of their URL records, the newest first."""
    counts = urls.groupBy("run_id").agg(F.count("*").alias("url_count"))
    return runs.join(counts, "run_id", "left").withColumn("url_count", F.coalesce("url_count", F.lit(0))).orderBy(F.desc("run_id"))


def latest_incomplete(runs: DataFrame) -> DataFrame:
    return runs.where("status in ('running', 'incomplete')").orderBy(F.desc("run_id")).limit(1)


def previous_run(runs: DataFrame) -> DataFrame:
    """runs with previous_id: the run before with the same start address."""
    return runs.withColumn("previous_id", F.lag("run_id").over(Window.partitionBy("start_url").orderBy("run_id")))


def within_quota(pages: DataFrame, quota: int, group: str, order: str, size: str) -> DataFrame:
    """The pages of each group whose bodies are kept: in order, a body stays if what is kept so far plus it fits;
    skipped ones take no room. A fold in order, by group, in Arrow batches; only sizes are gathered, not bodies."""
    import pandas as pd

    sizes = pages.select(group, order, size)
    schema = sizes.schema

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, used, keep = rows.sort_values(order), 0, []
        for n in rows[size]:
            fits = used + n <= quota
            keep.append(fits)
            used += n if fits else 0
        return rows[keep]

    return sizes.groupBy(group).applyInPandas(fold, schema)
