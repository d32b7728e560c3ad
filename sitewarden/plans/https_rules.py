"""Rules on HTTPS: hosts, certificates and the homepage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewarden.functions import urls as U
from sitewarden.operators.algebra import Output, draft_struct, gate_rows
from sitewarden.operators.evidence import Evidence, pointer
from sitewarden.plans.config import AuditConfig
from sitewarden.plans.page_rules import _say


def www_resolve(ev: Evidence, cfg: AuditConfig) -> Output:
    rule = "https.www_resolve"
    start = U.parse(ev.start_url) if ev.start_url else None
    names = U.apex_and_www(start.host) if start and start.host else None
    preferred = (cfg.text("preferred_host") or "").strip() or (start.host if start else "")
    by_kind = lambda kind: F.max_by(F.struct("requested_url", "destination_url", "failed_reason"), F.when(F.col("kind") == kind, 1))
    one = ev.host_probes.agg(by_kind("https_www").alias("w"), by_kind("https_apex").alias("a"), F.count_if(F.col("kind") == "https_www").alias("nw"), F.count_if(F.col("kind") == "https_apex").alias("na"))
    w, a = U.host_of(F.col("w.destination_url")), U.host_of(F.col("a.destination_url"))
    known = (F.col("nw") > 0) & (F.col("na") > 0) & (w.isNotNull() | F.col("w.failed_reason").isNotNull()) & (a.isNotNull() | F.col("a.failed_reason").isNotNull())
    gate = gate_rows(one, rule, start is None or names is not None, F.lit(start is not None) & known)
    if names is None:
        return Output([gate], [])
    wrong = ~(F.coalesce(w, F.lit("")) == preferred) | ~(F.coalesce(a, F.lit("")) == preferred)
    points = F.array(pointer("w.requested_url", "redirect_chain", _say("www -> ", F.coalesce("w.destination_url", F.lit("unresolved")))), pointer("a.requested_url", "redirect_chain", _say("apex -> ", F.coalesce("a.destination_url", F.lit("unresolved")))))
    drafts = one.where(known & wrong).select(draft_struct(rule, F.lit(f"{names[1]} / {names[0]}"), F.lit(f"The names of the site don't both lead to {preferred}."), f"Redirect both names to {preferred}.", points).alias("d")).select("d.*")
    return Output([gate], [drafts])


def non_secure(ev: Evidence) -> Output:
    rule = "https.non_secure_pages"
    start = U.parse(ev.start_url) if ev.start_url else None

    def insecure(who):
        test = U.scheme_of(who) == "http"
        return test if start is None else test & F.coalesce(U.host_of(who) == (start.host or ""), F.lit(False))

    def drafts(frame, who, n):
        return frame.where(insecure(who)).select(draft_struct(rule, who, _say(who, " is served without encryption."), "Serve the page over HTTPS.", F.array(pointer(who, "url_scheme", "http")), _say(str(n), who)).alias("d")).select("d.*")

    seen, records = F.col("identity"), F.col("identity")
    readable = r"^[A-Za-z][A-Za-z0-9+.-]*:"
    odd_pages = ev.observations.agg(F.count_if(~seen.rlike(readable)).alias("odd"), F.count_if(insecure(seen)).alias("bad"), F.count("*").alias("n"))
    waiting = records.isNull() & (F.coalesce(F.lower("reason").contains("queued"), F.lit(False)) | (F.col("state") == "pending"))
    odd_urls = ev.urls.agg(F.count_if(waiting | ~F.coalesce(records.rlike(readable), F.lit(True))).alias("odd2"), F.count_if(insecure(records)).alias("bad2"), F.count("*").alias("n2"))
    one = odd_pages.join(F.broadcast(odd_urls))
    complete = (F.col("n") + F.col("n2") > 0) & ((F.col("bad") + F.col("bad2") > 0) | (F.col("odd") + F.col("odd2") == 0))
    return Output([gate_rows(one, rule, True, complete)], [drafts(ev.observations.select("identity"), seen, 0), drafts(ev.urls.select("identity").where("identity is not null"), records, 1)])


def certificates(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    window = cfg.number("days_before_expiry")
    one = ev.tls_inspections.agg(F.count_if("inspected").alias("n"))
    rows = ev.tls_inspections.where("inspected")
    place = _say(F.col("host"), ":", F.col("port").cast("string"))
    site, names = _say("https://", F.col("host"), "/"), F.array_join("names", ",")
    out = []
    if "https.certificate_expiry" in wanted:
        rule, days = "https.certificate_expiry", F.expr(f"(not_after_unix - {ev.now}L) div 86400")
        fact = F.when(days < 0, _say("The certificate expired ", F.abs(days).cast("string"), " days ago.")).otherwise(_say("The certificate expires in ", days.cast("string"), " days."))
        found = rows.where(F.col("not_after_unix").isNotNull()).where(days <= window)
        out.append(Output([gate_rows(one, rule, True, F.col("n") > 0)], [found.select(draft_struct(rule, place, fact, f"Renew certificates {window} days before they expire.", F.array(pointer(site, "tls_certificate", _say("not_after=", F.col("not_after_unix").cast("string"), " names=", names)))).alias("d")).select("d.*")]))
    if "https.certificate_name" in wanted:
        rule, host = "https.certificate_name", F.regexp_replace(F.lower("host"), r"\.$", "")
        tail = F.regexp_replace(host, r"^[^.]+\.", "")
        covers = F.exists("names", lambda n: (F.regexp_replace(F.lower(n), r"\.$", "") == host) | ((F.regexp_replace(F.lower(n), r"\.$", "") == F.concat(F.lit("*."), tail)) & F.contains(host, F.lit("."))))
        found = rows.where(~F.col("hostname_ok") & ~F.coalesce(covers, F.lit(False)))
        out.append(Output([gate_rows(one, rule, True, F.col("n") > 0)], [found.select(draft_struct(rule, place, _say("The certificate doesn't name ", F.col("host")), "Serve a certificate that names the host.", F.array(pointer(site, "tls_certificate", _say("hostname=", F.col("host"), " names=", names)))).alias("d")).select("d.*")]))
    return out


def homepage(ev: Evidence, wanted: set[str]) -> list[Output]:
    out = []
    rule = "https.homepage_http_no_redirect"
    if rule in wanted:
        rows = ev.host_probes.where("kind = 'http_homepage'")
        lost = F.col("destination_url").isNull() & F.col("failed_reason").isNotNull()
        upgraded = (U.scheme_of(F.coalesce("destination_url", F.lit(""))) == "https") | F.exists("canonicals", lambda c: U.scheme_of(c) == "https")
        one = rows.agg(F.count("*").alias("n"), F.count_if(lost).alias("l"))
        hops = F.array_join(F.transform("redirect_chain", lambda h: F.concat(h["from"], F.lit(" -> "), h["to"], F.lit(" ("), h["status"].cast("string"), F.lit(")"))), "; ")
        chain = F.when(F.size("redirect_chain") > 0, hops).otherwise(_say("no redirect; destination ", F.coalesce("destination_url", "requested_url")))
        hints = F.when(F.size("canonicals") > 0, F.array_join("canonicals", ", ")).otherwise("no canonical")
        drafts = rows.where(~lost & ~upgraded).select(draft_struct(rule, F.lit("homepage"), F.lit("The plain homepage neither redirects to HTTPS nor names a secure canonical."), "Redirect the homepage to HTTPS.", F.array(pointer("requested_url", "redirect_chain", chain), pointer("requested_url", "canonical", hints))).alias("d")).select("d.*")
        out.append(Output([gate_rows(one, rule, True, (F.col("n") > 0) & (F.col("l") == 0))], [drafts]))
    rule = "https.homepage_not_https"
    if rule in wanted:
        url = U.parse(ev.start_url) if ev.start_url else None
        one = ev.spark.range(1)
        drafts = []
        if url is not None and url.scheme != "https":
            drafts.append(one.select(draft_struct(rule, F.lit("homepage"), F.lit("The configured homepage isn't secure."), "Start from the secure homepage.", F.array(pointer(F.lit(url.text()), "start_url", url.scheme))).alias("d")).select("d.*"))
        out.append(Output([gate_rows(one, rule, True, url is not None)], drafts))
    return out


def evaluate(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    out = [www_resolve(ev, cfg)] if "https.www_resolve" in wanted else []
    if "https.non_secure_pages" in wanted:
        out.append(non_secure(ev))
    return out + certificates(ev, cfg, wanted) + homepage(ev, wanted)


RULES = ["https.www_resolve", "https.non_secure_pages", "https.certificate_expiry", "https.certificate_name", "https.homepage_http_no_redirect", "https.homepage_not_https"]
