"""robots.txt: parsing, group choice and the longest-match decision."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSED = "struct<groups:array<struct<agents:array<string>,rules:array<struct<allow:boolean,pattern:string>>,crawl_delay:array<string>>>,sitemaps:array<string>,errors:array<string>>"


def decode(raw: bytes) -> tuple[str, list[str]]:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "", ["robots.txt is UTF-16, not UTF-8"]
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    try:
        return raw.decode("utf-8"), []
    except UnicodeDecodeError:
        return raw.decode("latin-1"), ["robots.txt is not valid UTF-8; read as Latin-1"]


def parse(text: str, errors: list[str] | None = None) -> dict:
    """Groups (user agents with their rules), sitemaps and format errors, `Line N: ...`."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    errors = list(errors or [])
    group, has_rules = None, False
    for number, line in enumerate(text.split("\n"), 1):  # at line feeds only; a carriage return before one is stripped
        body = line.split("#", 1)[0].strip()
        if not body:
            if not line.strip():
                group, has_rules = None, False
            continue
        name, colon, value = body.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            errors.append(f"Line {number}: no colon in '{body}'")
        elif name == "user-agent":
            if not value:
                errors.append(f"Line {number}: empty user-agent")
                continue
            if group is None or has_rules:
                group, has_rules = {"agents": [], "rules": [], "crawl_delay": []}, False
                groups.append(group)
            group["agents"].append(value)
        elif name in ("allow", "disallow", "crawl-delay"):
            if group is None:
                errors.append(f"Line {number}: {name} without a user-agent")
                continue
            has_rules = True
            if name == "crawl-delay":
                group["crawl_delay"].append(value)
            else:
                group["rules"].append({"allow": name == "allow", "pattern": value})
        elif name == "sitemap":
            sitemaps.append(value)
        else:
            errors.append(f"Line {number}: unknown field '{name}'")
    return {"groups": groups, "sitemaps": sitemaps, "errors": errors}


def _parse_all(bodies: pd.Series) -> pd.DataFrame:
    rows = [parse(*decode(bytes(b or b""))) for b in bodies]
    return pd.DataFrame({k: [r[k] for r in rows] for k in ("groups", "sitemaps", "errors")})


def parse_column(body: Column) -> Column:
    """parse() of a binary column, as PARSED."""
    return F.pandas_udf(_parse_all, PARSED)(body)


def product_token(user_agent: str) -> str:
    return re.match(r"[^/ \t(]*", user_agent)[0]


def select_group(parsed: dict, token: str) -> dict | None:
    """The rules for a product token: all groups with the longest agent that begins it, in any case; else those of `*`."""
    best, chosen = -1, []
    for group in parsed["groups"]:
        fits = [len(a) for a in group["agents"] if a != "*" and token.lower().startswith(a.lower())]
        if fits and max(fits) >= best:
            chosen = chosen + [group] if max(fits) == best else [group]
            best = max(fits)
    if not chosen:
        chosen = [g for g in parsed["groups"] if "*" in g["agents"]]
        if not chosen:
            return None
        best = -1
    name = "*" if best < 0 else token[:best].lower()
    return {"agent": name, "rules": [r for g in chosen for r in g["rules"]], "crawl_delay": [d for g in chosen for d in g["crawl_delay"]]}


def to_regex(pattern: str) -> str:
    """A path pattern (`*`, final `$`) as an anchored regular expression for Java and Python alike."""
    anchored = pattern.endswith("$")
    body = unquote(pattern[:-1] if anchored else pattern)
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + ("$" if anchored else "")


def decide(group: dict | None, path: str) -> tuple[bool, str | None]:
    """(allowed, deciding pattern): the longest matching pattern, allow before disallow at a tie."""
    best = None
    for rule in (group or {"rules": []})["rules"]:
        if rule["pattern"] and re.match(to_regex(rule["pattern"]), unquote(path), re.S):
            key = (len(rule["pattern"]), rule["allow"])
            if best is None or key > best[0]:
                best = (key, rule)
    return (True, None) if best is None else (best[1]["allow"], best[1]["pattern"])


def best_rules(urls: DataFrame, rules: DataFrame, path: Column) -> DataFrame:
    """urls with allowed and pattern: the longest of the rules (allow, pattern, regex) that match the path.

    The rules of one robots.txt are few and are broadcast; matches are aggregated to a maximum on the map side, so no
    URL's matches are gathered. urls needs a column `identity`."""
    hits = urls.select("identity", path.alias("_path")).join(F.broadcast(rules), F.expr("_path rlike regex"))
    best = hits.groupBy("identity").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow", "pattern")).alias("best"))
    return urls.join(best, "identity", "left").withColumn("allowed", F.coalesce("best.allow", F.lit(True))).withColumn("pattern", F.col("best.pattern")).drop("best")


def decisions(urls: DataFrame, fetch_kind: str, group: dict | None, path: Column, bypass: bool = False) -> DataFrame:
    """urls with allowed and reason. Without a robots.txt that could be read everything is allowed; an owner's bypass
    turns a block into an allowance that says so."""
    if fetch_kind != "fetched" or not group or not group["rules"]:
        reason = {"not_found": "robots.txt not found", "unavailable": "robots.txt unavailable"}.get(fetch_kind, "no rule")
        return urls.withColumn("allowed", F.lit(True)).withColumn("reason", F.lit(reason))
    rules = urls.sparkSession.createDataFrame([(r["allow"], r["pattern"], to_regex(r["pattern"])) for r in group["rules"] if r["pattern"]], "allow boolean, pattern string, regex string")
    found = best_rules(urls, rules, path)
    said = F.when(F.col("pattern").isNull(), "no rule").otherwise(F.concat(F.when(F.col("allowed"), "Allow: ").otherwise("Disallow: "), F.col("pattern")))
    if bypass:
        return found.withColumn("reason", F.when(F.col("allowed"), said).otherwise(F.concat(F.lit("bypassed "), said))).withColumn("allowed", F.lit(True)).drop("pattern")
    return found.withColumn("reason", said).drop("pattern")


def _rules_for(token: str):
    def each(bodies: pd.Series) -> pd.Series:
        found = (select_group(parse(*decode(bytes(b or b""))), token) for b in bodies)
        return pd.Series([[{"allow": r["allow"], "pattern": r["pattern"], "regex": to_regex(r["pattern"])} for r in (g or {"rules": []})["rules"] if r["pattern"]] for g in found], dtype=object)

    return F.pandas_udf(each, "array<struct<allow:boolean,pattern:string,regex:string>>")


def decide_all(urls: DataFrame, policies: DataFrame, token: str, origin: Column, path: Column) -> DataFrame:
    """urls with allowed and reason, each by the policy of its own origin.

    policies: (origin, fetch_kind, body), one row an origin. Each body is parsed once; its rules for the product token
    meet the distinct paths of their origin in an equi-join, and the longest that matches is a maximum. An origin whose
    policy wasn't found, couldn't be read, or isn't known allows everything."""
    kinds = policies.select(F.col("origin").alias("_o"), F.col("fetch_kind").alias("_kind"))
    rules = policies.where("fetch_kind = 'fetched'").select(F.col("origin").alias("_o"), F.explode(_rules_for(token)(F.col("body"))).alias("r")).select("_o", "r.*")
    keyed = urls.withColumns({"_o": origin, "_path": path})
    hits = keyed.select("_o", "_path").distinct().join(rules, "_o").where(F.expr("_path rlike regex"))
    best = hits.groupBy("_o", "_path").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow", "pattern")).alias("_best"))
    found = keyed.join(best, ["_o", "_path"], "left").join(kinds, "_o", "left")
    said = F.when(F.col("_best").isNotNull(), F.concat(F.when(F.col("_best.allow"), "Allow: ").otherwise("Disallow: "), F.col("_best.pattern")))
    why = F.when(F.col("_kind") == "not_found", "robots.txt not found").when(F.col("_kind") == "fetched", "no rule").otherwise("robots.txt unavailable")
    return found.select(*urls.columns, F.coalesce("_best.allow", F.lit(True)).alias("allowed"), F.coalesce(said, why).alias("reason"))
