"""Sitemaps: bounded decompression, the ordered locations of a document, and the walk over sitemap indexes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sitewarden.functions import urls as U

#: The limits of the crawl.
MAX_BYTES, MAX_DEPTH, MAX_FILES = 1 << 20, 4, 64
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def inflate(body: bytes, limit: int = MAX_BYTES) -> bytes | None:
    """A body, decompressed if it is gzip; None if it is larger than the limit or damaged."""
    if body[:2] == b"\x1f\x8b":
        try:
            engine = zlib.decompressobj(31)
            body = engine.decompress(body, limit + 1)
        except zlib.error:
            return None
    return body if len(body) <= limit else None


def parse(text: str) -> tuple[str, list[str]] | None:
    """(urlset or sitemapindex, locations) of a document; None if the root is another or missing."""
    text = re.sub(r"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "", text, flags=re.S).strip().lstrip("﻿").strip()
    root = re.match(r"<(?:[\w.-]+:)?(urlset|sitemapindex)[\s>/]", text)
    if not root or not re.search(rf"</(?:[\w.-]+:)?{root[1]}\s*>\s*$|^<[^>]*/>\s*$", text):
        return None
    found = []
    for raw in re.findall(r"<(?:[\w.-]+:)?loc(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?loc\s*>", text, re.S):
        raw = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", raw, flags=re.S).strip()
        found.append(re.sub(r"&(amp|lt|gt|quot|apos);", lambda m: _ENTITIES[m[1]], raw))
    return root[1], found


@udtf(returnType="kind: string, seq: int, loc: string")
class SitemapLocations:
    """A row for each location of a sitemap document; kind `parse_error` or `oversized` without locations. The second
    argument is the most bytes of a document, those of the crawl if it is left out."""

    def eval(self, body: bytes, limit: int = MAX_BYTES) -> Iterator[tuple]:
        raw = inflate(bytes(body or b""), limit)
        parsed = None if raw is None else parse(raw.decode("utf-8", "replace"))
        if parsed is None:
            yield ("oversized" if raw is None else "parse_error", None, None)
            return
        for i, loc in enumerate(parsed[1]):
            yield parsed[0], i, loc
        if not parsed[1]:
            yield parsed[0], None, None


def _parse_all(bodies: pd.Series) -> pd.DataFrame:
    kinds, found = [], []
    for body in bodies:
        raw = inflate(bytes(body or b""))
        parsed = None if raw is None else parse(raw.decode("utf-8", "replace"))
        kinds.append("oversized" if raw is None else "parse_error" if parsed is None else parsed[0])
        found.append(parsed[1] if parsed else [])
    return pd.DataFrame({"kind": kinds, "locations": found})


def parse_column(body: Column) -> Column:
    """A document's kind (urlset, sitemapindex, oversized, parse_error) and its locations; a null body is an empty one."""
    return F.pandas_udf(_parse_all, "kind string, locations array<string>")(body)


def _admit(queue: list[tuple[str, str, int]], files: int, seen: set[str], origin: str) -> list[tuple[dict, int]]:
    """(record, depth) of a level in queue order; the state of those that can be fetched is still open (None)."""
    home, out = U.parse(origin), []
    for href, parent, depth in queue:
        target = U.parse(href, U.parse(parent))
        record = {"url": href, "identity": target.text(fragment=False) if target else None, "state": None, "reason": "", "listed_urls": 0}
        if files + len(out) >= MAX_FILES:
            record |= {"identity": None, "state": "capped", "reason": f"more than {MAX_FILES} files"}
        elif depth > MAX_DEPTH:
            record |= {"identity": None, "state": "depth_limit", "reason": f"deeper than {MAX_DEPTH}"}
        elif target is None:
            record |= {"state": "parse_error", "reason": "not an address"}
        elif (target.scheme, target.host, target.effective_port) != (home.scheme, home.host, home.effective_port):
            record |= {"state": "cross_origin", "reason": "another origin"}
        elif record["identity"] in seen:
            record |= {"state": "cycle", "reason": "already visited"}
        else:
            seen.add(record["identity"])
        out.append((record, depth))
    return out


def walk(documents: DataFrame, roots: list[str], origin: str) -> tuple[list[dict], list[dict]]:
    """(files, urls) of the sitemaps reached from roots, breadth first, each file once, within the limits.

    documents has (url, body), of one address one row. The files of a level are chosen in the order of the queue, at
    most MAX_FILES in all whatever becomes of them; one lookup finds their bodies, which are parsed where they are, and
    only locations come back."""
    files, urls, seen, queue = [], [], set(), [(r, origin, 0) for r in roots]
    while queue:
        level = _admit(queue, len(files), seen, origin)
        wanted = [r["identity"] for r, _ in level if r["state"] is None]
        rows = documents.where(F.col("url").isin(*wanted)).select("url", parse_column(F.col("body")).alias("p")).select("url", "p.*").collect() if wanted else []
        found, queue = {r["url"]: (r["kind"], list(r["locations"])) for r in rows}, []
        for record, depth in level:
            files.append(record)
            if record["state"] is not None:
                continue
            kind, locations = found.get(record["identity"], ("inaccessible", []))
            if kind in ("urlset", "sitemapindex"):
                record |= {"state": "fetched", "listed_urls": len(locations)}
            else:
                record |= {"state": kind, "reason": {"oversized": f"more than {MAX_BYTES} bytes", "parse_error": "no urlset or sitemapindex"}.get(kind, "not fetched")}
            if kind == "sitemapindex":
                queue += [(loc, record["identity"], depth + 1) for loc in locations]
            elif kind == "urlset":
                urls += [{"original": loc, "source_sitemap": record["identity"]} for loc in locations]
    return files, urls
