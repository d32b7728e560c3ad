"""Rules on canonicals, sitemaps and robots.txt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import urls as U
from sitewarden.operators.algebra import Output, Spec, draft_struct, evaluate_specs, gate_rows
from sitewarden.operators.evidence import UNSETTLED, Evidence, pointer
from sitewarden.plans.config import AuditConfig
from sitewarden.plans.page_rules import _say, _text


def canonicals(ev: Evidence) -> DataFrame:
    """Declared canonicals of complete pages by position, resolved, with the target (t: null if nothing is known)."""
    rows = ev.complete_pages.select("identity", "key", "in_sitemap", F.posexplode("canonicals").alias("pos", "href"))
    rows = rows.withColumn("target", U.resolve_of(F.col("identity"), F.col("href")))
    first = rows.groupBy("identity", "target").agg(F.min("pos").alias("pos"))
    # of equal targets on a page the first counts; what can't be resolved counts each time
    rows = rows.join(first.where("target is not null").withColumn("first", F.lit(True)), ["identity", "target", "pos"], "left")
    known = ev.targets.select(F.col("key").alias("target"), F.struct("state", "status", "failed_reason", "noindex", "observed").alias("t"))
    return rows.join(known, "target", "left")


def canonical_broken(ev: Evidence) -> Output:
    rule, t = "canonical.broken", F.col("t")
    rows = canonicals(ev)
    counted = F.col("target").isNotNull() & F.coalesce("first", F.lit(False)) & (F.col("target") != F.col("key"))
    unsettled = t["state"].isin(*UNSETTLED) & ~t["observed"]
    missing = counted & (t.isNull() | F.coalesce(unsettled, F.lit(False)) | (t["status"].isNull() & t["failed_reason"].isNull()))
    arrow = _say(F.col("href"), " -> ", F.col("target"))
    kind = (
        F.when(F.col("target").isNull(), F.struct(_say("A canonical can't be resolved: ", F.col("href")).alias("fact"), F.col("href").alias("excerpt")))
        .when(counted & t["status"].between(400, 599), F.struct(_say("The canonical ", F.col("target"), " answers ", t["status"].cast("string")).alias("fact"), _say(arrow, " HTTP ", t["status"].cast("string")).alias("excerpt")))
        .when(counted & t["status"].isNull() & t["failed_reason"].isNotNull(), F.struct(_say("The canonical ", F.col("target"), " failed: ", t["failed_reason"]).alias("fact"), _say(arrow, " ", t["failed_reason"]).alias("excerpt")))
        .when(counted & t["noindex"], F.struct(_say("The canonical ", F.col("target"), " forbids indexing", F.when(F.col("in_sitemap"), "; the sitemap lists the page.").otherwise(".")).alias("fact"), _say(arrow, " noindex").alias("excerpt")))
    )
    found = rows.withColumn("k", kind).where("k is not null")
    order = _say(F.col("identity"), "\t", F.lpad(F.col("pos").cast("string"), 9, "0"))
    drafts = found.select(draft_struct(rule, F.col("identity"), F.col("k.fact"), "Name one canonical that can be fetched and indexed.", F.array(pointer("identity", "canonical", F.col("k.excerpt"))), order).alias("d")).select("d.*")
    one = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(missing, F.lit(False))).alias("u")).join(F.broadcast(ev.page_counts))
    any_page = F.col("n_complete") > 0
    return Output([gate_rows(one, rule, ~any_page | (F.col("n") > 0), any_page & (F.col("u") == 0))], [drafts])


def canonical_multiple(ev: Evidence) -> Output:
    rule = "canonical.multiple"
    rows = canonicals(ev).where("target is not null")
    many = rows.groupBy("identity").agg(F.count_distinct("target").alias("n")).where("n > 1")
    # at most two distinct targets matter; the list of hrefs is the page's own array
    found = ev.complete_pages.select("identity", "canonicals").join(many, "identity")
    drafts = found.select(draft_struct(rule, F.col("identity"), _say("The page names ", F.col("n").cast("string"), " canonicals."), "Keep one canonical.", F.array(pointer("identity", "canonical", F.array_join("canonicals", " | ")))).alias("d")).select("d.*")
    return Output([gate_rows(ev.page_counts, rule, True, F.col("n_complete") > 0)], [drafts])


def _sitemap_ready(ev: Evidence) -> bool:
    return ev.sitemap_known and ev.sitemap_done


def sitemap_files(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    url, reason, state = F.col("url"), _text(F.col("reason")), F.col("state")
    limit = cfg.number("max_sitemap_urls")
    specs = [
        Spec("sitemap.format_errors", state == "parse_error", url, _say("The sitemap is no valid XML: ", reason), "Serve a well-formed sitemap.", [pointer(url, "sitemap_xml", reason)]),
        Spec("sitemap.oversized", (F.col("listed_urls") > limit) | (state == "oversized"), url, _say("The sitemap is too large: ", F.col("listed_urls").cast("string"), " addresses."), "Split the sitemap.", [pointer(url, "sitemap_url_count", _say(F.col("listed_urls").cast("string"), " ", reason))]),
    ]
    out = []
    counts = ev.sitemap_files.agg(F.count("*").alias("n"))
    for spec in specs:
        if spec.rule_id in wanted:
            found = evaluate_specs(ev.sitemap_files, [spec], counts, "n")
            out.append(Output([gate_rows(counts, spec.rule_id, F.lit(not _sitemap_ready(ev)) | (F.col("n") > 0), _sitemap_ready(ev))], found.drafts))
    if "sitemap.not_found" in wanted:
        rule = "sitemap.not_found"
        lost = ev.sitemap_files.where(state == "inaccessible").select(draft_struct(rule, url, _say("The sitemap wasn't found: ", reason), "Serve the sitemap where it is declared.", F.array(pointer(url, "sitemap_http_status", reason))).alias("d")).select("d.*")
        origin = F.regexp_replace(F.max("origin"), "/+$", "")
        expected = ev.robots.agg(F.coalesce(F.try_element_at(F.max("sitemaps"), F.lit(1)), F.concat(origin, F.lit("/sitemap.xml")), F.lit("/sitemap.xml")).alias("expected"))
        none = expected.join(F.broadcast(counts)).where("n = 0").select(draft_struct(rule, F.col("expected"), F.lit("No sitemap was fetched."), "Publish a sitemap and declare it.", F.array(pointer("expected", "sitemap_http_status", "not requested"))).alias("d")).select("d.*")
        out.append(Output([gate_rows(counts, rule, True, _sitemap_ready(ev))], [lost, none]))
    return out


def sitemap_incorrect(ev: Evidence) -> Output:
    """sitemap.incorrect_pages: listed addresses that are blocked, fail, redirect, aren't canonical or forbid indexing."""
    rule = "sitemap.incorrect_pages"
    listed = U.with_identity(ev.sitemap_urls.where("skip_reason is null"), F.coalesce("identity", "original"), "key")
    pages = ev.pages.groupBy("key").agg(F.max_by(F.struct("identity", "status", "redirect_chain", "canonicals", "noindex"), "identity").alias("o"))
    # a page's canonical is resolved before the addresses take the page up: there may be many more of them than pages
    first = F.try_element_at(F.col("o.canonicals"), F.lit(1))
    pages = pages.withColumn("canonical", U.resolve_of(F.col("o.identity"), first))
    rows = listed.select("key", "original", "source_sitemap").join(ev.url_keys.select("key", "state", "failed_reason"), "key", "left").join(pages, "key", "left")
    chain = F.aggregate("o.redirect_chain", F.try_element_at("o.redirect_chain", F.lit(1))["from"], lambda s, h: F.concat(s, F.lit(" -"), h["status"].cast("string"), F.lit("-> "), h["to"]))
    hops = F.when(F.size("o.redirect_chain") > 0, chain).otherwise(_say("HTTP ", F.col("o.status").cast("string")))
    seen, blocked = F.col("o").isNotNull(), F.coalesce(F.col("state") == "blocked", F.lit(False))

    def draft(n: int, who: Column, fact: str, field: str, excerpt: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), who.alias("who"), F.lit(fact).alias("fact"), F.lit(field).alias("field"), excerpt.cast("string").alias("excerpt"))

    source, page = F.col("source_sitemap"), F.col("o.identity")
    reasons = F.array_compact(F.array(
        F.when(blocked, draft(0, source, "is blocked by robots.txt", "sitemap_url", _say(F.col("original"), " blocked"))),
        F.when(~blocked & ~seen & F.col("failed_reason").isNotNull(), draft(1, source, "failed", "sitemap_url", F.col("original"))),
        F.when(~blocked & seen & F.col("o.status").between(400, 599), draft(2, page, "answers an error", "page_http_status", F.col("o.status"))),
        F.when(~blocked & seen & ((F.size("o.redirect_chain") > 0) | F.col("o.status").isin(301, 302, 307, 308)), draft(3, page, "redirects", "sitemap_url", hops)),
        F.when(~blocked & seen & (F.col("canonical") != F.col("key")), draft(4, page, "has another canonical", "canonical", F.col("canonical"))),
        F.when(~blocked & seen & F.col("o.noindex"), draft(5, page, "forbids indexing", "sitemap_url", F.lit("noindex"))),
    ))
    unsettled = F.coalesce(F.col("state").isin(*UNSETTLED), F.lit(False))
    unknown = unsettled | (~blocked & ~seen & F.col("failed_reason").isNull())
    found = rows.select("key", "original", "source_sitemap", F.explode(reasons).alias("r"))
    order = _say(F.col("source_sitemap"), "\t", F.col("original"), "\t", F.col("r.n").cast("string"))
    drafts = found.select(draft_struct(rule, F.col("key"), _say("The sitemap lists ", F.col("original"), ", which ", F.col("r.fact"), "."), "List final, canonical pages that can be indexed.", F.array(pointer(F.col("r.who"), "sitemap_url", F.col("r.excerpt")).withField("field", F.col("r.field"))), order).alias("d")).select("d.*")
    one = rows.agg(F.count("*").alias("n"), F.count_if(unknown).alias("u"))
    ready = _sitemap_ready(ev)
    return Output([gate_rows(one, rule, F.lit(not ready) | (F.col("n") > 0), F.lit(ready) & (F.col("u") == 0))], [drafts])


def sitemap_http(ev: Evidence) -> Output:
    rule = "sitemap.http_urls_in_https"
    files = ev.sitemap_files.where(U.scheme_of(F.col("url")) == "https")
    fetched = files.where("state = 'fetched'").select(F.col("url").alias("source_sitemap")).distinct()
    rows = ev.sitemap_urls.join(fetched, "source_sitemap", "left_semi").withColumn("loc", F.coalesce(U.resolve_of(F.col("source_sitemap"), F.col("original")), "original"))
    drafts = rows.where(U.scheme_of(F.col("loc")) == "http").select(draft_struct(rule, F.col("loc"), _say("A secure sitemap lists ", F.col("original")), "List secure addresses.", F.array(pointer("source_sitemap", "sitemap_xml", F.col("original"))), _say(F.col("source_sitemap"), "\t", F.col("original"))).alias("d")).select("d.*")
    one = files.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "fetched").alias("f"))
    ready = _sitemap_ready(ev)
    return Output([gate_rows(one, rule, F.lit(not ready) | (F.col("n") > 0), F.lit(ready) & (F.col("f") > 0))], [drafts])


def robots(ev: Evidence, wanted: set[str]) -> list[Output]:
    origin, kind = F.col("origin"), F.col("fetch_kind")
    text = _say(F.regexp_replace(origin, "/+$", ""), "/robots.txt")
    one = ev.robots.agg(F.count("*").alias("n"), F.max("fetch_kind").alias("kind"))
    any_robots, got = F.col("n") > 0, F.coalesce(F.col("kind") == "fetched", F.lit(False))
    rules = {
        "sitemap.not_declared_in_robots": ((kind == "fetched") & (F.size("sitemaps") == 0), F.lit("robots.txt declares no sitemap."), "Declare the sitemap in robots.txt.", "robots_txt", F.lit("Sitemap directive absent"), F.lit(True), got),
        "robots.format_errors": ((kind == "fetched") & (F.size("format_errors") > 0), _say("robots.txt has errors: ", F.array_join("format_errors", "; ")), "Correct the directives.", "robots_txt", F.array_join("format_errors", "\n"), ~any_robots | got, any_robots),
        "robots.not_found": (kind == "not_found", _say("robots.txt answers ", F.col("fetch_status").cast("string")), "Publish robots.txt if a policy is wanted.", "robots_http_status", F.col("fetch_status").cast("string"), F.lit(True), any_robots & (F.col("kind") != "unavailable")),
    }
    out = []
    for rule, (where, fact, advice, field, excerpt, applicable, complete) in rules.items():
        if rule in wanted:
            drafts = ev.robots.where(where).select(draft_struct(rule, origin, fact, advice, F.array(pointer(text, field, excerpt))).alias("d")).select("d.*")
            out.append(Output([gate_rows(one, rule, applicable, complete)], [drafts]))
    rule = "robots.pages_blocked_from_crawling"
    if rule in wanted:
        who = F.coalesce("identity", "original")
        drafts = ev.urls.where("state = 'blocked'").select(draft_struct(rule, who, _say("robots.txt forbids ", who, ": ", _text(F.col("reason"))), "Allow the path if it should be crawled.", F.array(pointer(who, "url", _text(F.col("reason")))), _say(who, "\t", F.col("original"))).alias("d")).select("d.*")
        out.append(Output([gate_rows(one, rule, True, any_robots & F.lit(ev.has_urls))], [drafts]))
    return out


def evaluate(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    out = []
    if "canonical.broken" in wanted:
        out.append(canonical_broken(ev))
    if "canonical.multiple" in wanted:
        out.append(canonical_multiple(ev))
    out += sitemap_files(ev, cfg, wanted)
    if "sitemap.incorrect_pages" in wanted:
        out.append(sitemap_incorrect(ev))
    if "sitemap.http_urls_in_https" in wanted:
        out.append(sitemap_http(ev))
    return out + robots(ev, wanted)


RULES = [
    "canonical.broken", "canonical.multiple", "sitemap.format_errors", "sitemap.incorrect_pages", "sitemap.oversized",
    "sitemap.not_declared_in_robots", "sitemap.not_found", "sitemap.http_urls_in_https", "robots.format_errors",
    "robots.not_found", "robots.pages_blocked_from_crawling",
]
