"""Responses as the extractor wants them: from stored pages, and from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADERS = "array<struct<name:string,value:string>>"


def _responses(rows: DataFrame, url: Column, body: Column, content_type: Column, status: Column, max_bytes: int) -> DataFrame:
    raw = body.cast("binary")
    return rows.select(url.alias("url"), status.cast("int").alias("status"), content_type.alias("content_type"), F.array().cast(_HEADERS).alias("headers"), F.substring(raw, 1, max_bytes).alias("body"), (F.octet_length(raw) > max_bytes).alias("truncated"), F.lit(None).cast("long").alias("duration_ms"))


def from_pages(pages: DataFrame, url: str = "url", markup: str = "html", max_bytes: int = 1 << 20) -> DataFrame:
    """Pages that were stored as text, as successful responses."""
    return _responses(pages, F.col(url), F.col(markup), F.lit("text/html"), F.lit(200), max_bytes)


def from_files(spark: SparkSession, path: str, site: str, max_bytes: int = 1 << 20) -> DataFrame:
    """Files below a folder as the pages of a site: the address is the site and the path below the folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.regexp_replace(F.element_at(F.split("path", F.lit(path.rstrip("/").rsplit("/", 1)[-1] + "/")), -1), r"index\.html$", "")
    kind = F.when(F.lower("path").rlike(r"\.(html?|xhtml)$"), "text/html").when(F.lower("path").endswith(".xml"), "application/xml").otherwise("application/octet-stream")
    return _responses(rows, F.concat(F.lit(site.rstrip("/") + "/"), below), F.col("content"), kind, F.lit(200), max_bytes)
