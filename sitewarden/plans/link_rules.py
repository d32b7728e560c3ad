"""Rules over the links and the embedded resources of complete pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import text as T
from sitewarden.functions import urls as U
from sitewarden.operators.algebra import Output, Spec, draft_struct, evaluate_specs, gate_rows
from sitewarden.operators.evidence import Evidence, pointer
from sitewarden.plans.config import AuditConfig
from sitewarden.plans.page_rules import _say, _text

#: Media types that aren't pages.
RESOURCE_TYPE = r"^(image|audio|video|font)/|^(text/css|text/javascript|application/javascript|application/ecmascript|application/pdf|application/zip|application/font-woff|application/font-woff2)$"


#: Link rules that look at what is known of a link's target.
OF_TARGETS = {"links.broken_internal", "links.broken_external", "links.resources_as_page_link"}


def link_specs(cfg: AuditConfig) -> list[Spec]:
    ident, dest, href, anchor, rel = (F.col(c) for c in ("identity", "destination", "href", "anchor", "rel"))
    status, reason = F.col("t.status"), F.col("t.failed_reason")
    target = F.coalesce(dest, href)
    entity = _say(ident, " -> ", target, " #", F.col("seq").cast("string"))
    order = _say(ident, "\t", F.lpad(F.col("seq").cast("string"), 9, "0"))
    nav, internal, external = F.col("nav"), F.col("host_owner") == "same_host", F.col("host_owner") == "other_host"
    label = F.when(status.isNotNull(), _say("HTTP ", status.cast("string"))).when(reason.isNotNull(), _say("fetch failed (", reason, ")")).otherwise("status unknown")
    unknown = status.isNull() & reason.isNull()
    broken = F.when(status.isNotNull(), status.between(400, 599)).otherwise(T.is_transport_failure(reason))
    quoted = _say('anchor="', anchor, '" href=', href, " ")
    media = T.ascii_lower(F.trim(F.split(F.col("t.content_type"), ";")[0]))
    max_chars = cfg.number("max_link_chars")
    generic = [w for w in (w.strip().lower() for w in cfg.text("generic_anchor_list").split(",")) if w]
    nofollow = F.exists(F.split(rel, "[ ,;]"), lambda t: T.ascii_lower(F.trim(t)) == "nofollow")
    http = U.scheme_of(F.coalesce(dest, href)) == "http"
    secure = U.scheme_of(ident) == "https"

    def link(rule_id, where, fact, recommendation, field, excerpt, scope=None, unknown=None, entity=entity) -> Spec:
        return Spec(rule_id, where, entity, fact, recommendation, [pointer(ident, field, excerpt)], scope, unknown, order)

    return [
        link("links.broken_internal", broken, _say("The link from ", ident, " to ", target, " is broken: ", label), "Repair or remove the link.", "anchor_href", _say(quoted, label), nav & internal, unknown),
        link("links.broken_external", broken & ~F.coalesce(status == 403, F.lit(False)), _say("The link from ", ident, " to ", target, " is broken: ", label), "Repair, replace or remove the link.", "anchor_href", _say(quoted, label), nav & external, unknown),
        link("url.malformed_link", (F.trim(href) != "") & dest.isNull() & (F.col("host_owner") == "opaque"), _say("The link from ", ident, " can't be read: ", href), "Write an address that can be parsed.", "anchor_href", href, entity=_say(ident, " href=", href, " #", F.col("seq").cast("string"))),
        link("links.url_too_long", F.length(target) > max_chars, _say("The link's address has ", F.length(target).cast("string"), " characters."), f"Keep link addresses within {max_chars} characters.", "anchor_href", target),
        link("links.internal_outgoing_nofollow", nofollow, _say("The internal link from ", ident, " is marked nofollow."), "Let internal links be followed.", "anchor_rel", _say("rel=", rel, " href=", href), nav & internal),
        link("links.external_outgoing_nofollow", nofollow, _say("The external link from ", ident, " is marked nofollow."), "Recorded only.", "anchor_rel", _say("rel=", rel, " href=", href), nav & external),
        link("links.non_descriptive_anchors", nav & T.ascii_lower(T.collapse(anchor)).isin(generic), _say("The link text says nothing: ", anchor), "Name the target in the link text.", "anchor_text", anchor),
        link("links.missing_anchor_text", nav & (T.collapse(anchor) == ""), _say("The link to ", href, " has no text."), "Give the link a text or its image an alt text.", "anchor_text", ""),
        link("links.resources_as_page_link", media.rlike(RESOURCE_TYPE), _say("The link from ", ident, " leads to a file of type ", _text(F.col("t.content_type"))), "Link to pages.", "anchor_href", _say("href=", href, " content-type=", _text(F.col("t.content_type"))), nav, F.col("t.content_type").isNull()),
        link("https.https_links_to_http", http, _say("The secure page ", ident, " links to ", target), "Link to the secure address.", "anchor_href", _say("href=", href, " dest=", target), None, None),
    ], nav, external, unknown, secure


def _forbidden_resources(ev: Evidence) -> DataFrame:
    """External resources that answered 403, a draft for each address."""
    hits = ev.resources_where(F.col("host_owner") == "other_host").where("key is not null").where((F.col("fetch.status") == 403) & ~F.col("fetch.challenge"))
    grouped = _by_address(hits, "target_http_status", _say("href=", F.col("href"), " HTTP 403"))
    return grouped.select(draft_struct("links.external_http_403", _say("resource::", F.col("key")), _say("The resource ", F.col("key"), " answers 403 to ", F.col("referrers")), "Treat 403 as limited access, not as a broken target.", F.col("points"), _say("1", F.col("key"))).alias("d")).select("d.*")


def _by_address(hits: DataFrame, field: str, excerpt: Column) -> DataFrame:
    """Hits by address: the referring pages, joined, and a pointer for each hit in page order."""
    points = F.sort_array(F.collect_list(F.struct("identity", "seq", pointer("identity", field, excerpt).alias("p"))))
    return hits.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("identity")), ", ").alias("referrers"), F.transform(points, lambda x: x["p"]).alias("points"), F.first("fetch").alias("fetch"))


def links(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    specs, nav, external, unknown, secure = link_specs(cfg)
    out = []
    https = [s for s in specs if s.rule_id == "https.https_links_to_http" and s.rule_id in wanted]
    plain = [s for s in specs if s.rule_id in wanted and s not in https]
    if plain:
        rows = ev.links if OF_TARGETS & {s.rule_id for s in plain} else ev.plain_links()
        out.append(evaluate_specs(rows, plain, ev.page_counts, "n_complete"))
    if https:
        rows = ev.plain_links().where(secure & (F.col("host_owner") != "opaque"))
        found = evaluate_specs(rows, https, ev.page_counts, "n_complete")
        out.append(Output([_needs_https(ev, https[0].rule_id)], found.drafts))
    if "links.external_http_403" in wanted:
        rule = "links.external_http_403"
        rows = ev.links.where(nav & external)
        status = F.col("t.status")
        entity = _say(F.col("identity"), " -> ", F.col("destination"), " #", F.col("seq").cast("string"))
        order = _say("0", F.col("identity"), "\t", F.lpad(F.col("seq").cast("string"), 9, "0"))
        excerpt = _say('anchor="', F.col("anchor"), '" href=', F.col("href"), " HTTP 403")
        pages = rows.where(status == 403).select(draft_struct(rule, entity, _say("The target ", F.col("destination"), " answers 403."), "Treat 403 as limited access, not as a broken target.", F.array(pointer("identity", "target_http_status", excerpt)), order).alias("d")).select("d.*")
        resources = _forbidden_resources(ev)
        one = rows.agg(F.count("*").alias("n"), F.count_if(unknown).alias("u")).join(F.broadcast(resources.agg(F.count("*").alias("r")))).join(F.broadcast(ev.page_counts))
        any_page = F.col("n_complete") > 0
        out.append(Output([gate_rows(one, rule, ~any_page | (F.col("n") + F.col("r") > 0), any_page & (F.col("u") == 0))], [pages, resources]))
    return out


def _needs_https(ev: Evidence, rule: str) -> DataFrame:
    """Incomplete without a complete page, not applicable without a secure one."""
    one = ev.complete_pages.agg(F.count("*").alias("n"), F.count_if(U.scheme_of(F.col("identity")) == "https").alias("s"))
    return gate_rows(one, rule, (F.col("n") == 0) | (F.col("s") > 0), F.col("n") > 0)


def resources(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    out = []
    ident, fetch = F.col("identity"), F.col("fetch")
    limited = fetch["challenge"] | F.coalesce(fetch["status"].isin(401, 403, 429), F.lit(False)) | F.coalesce(F.lower(fetch["failed_reason"]).contains("challenge"), F.lit(False))
    known = F.coalesce(fetch["robots_blocked"] | fetch["status"].isNotNull() | fetch["failed_reason"].isNotNull() | fetch["challenge"], F.lit(False))
    broken = ~limited & ~fetch["robots_blocked"] & F.when(fetch["status"].isNotNull(), fetch["status"].between(400, 599)).otherwise(T.is_transport_failure(fetch["failed_reason"]))
    label = F.when(fetch["challenge"], "challenge page").when(fetch["status"].isNotNull(), _say("HTTP ", fetch["status"].cast("string"))).when(fetch["failed_reason"].isNotNull(), _say("fetch failed (", fetch["failed_reason"], ")")).otherwise("status unknown")
    for rule, (owner, kinds, noun, advice) in BROKEN.items():
        if rule in wanted:
            hits = ev.resources_where((F.col("host_owner") == owner) & F.col("kind").isin(*kinds)).where("key is not null")
            grouped = _by_address(hits.where(broken), "resource_http_status", _say("kind=", F.col("kind"), " href=", F.col("href"), " ", label))
            drafts = grouped.select(draft_struct(rule, F.col("key"), _say(f"{noun} ", F.col("key"), " is broken (", label, ") for ", F.col("referrers")), advice, F.col("points")).alias("d")).select("d.*")
            out.append(Output([_resource_gate(ev, rule, hits, ~known)], [drafts]))
    for rule, owner in (("resources.blocked_internal_robots", "same_host"), ("resources.blocked_external_robots", "other_host")):
        if rule in wanted:
            hits = ev.resources_where(F.col("host_owner") == owner).where("key is not null")
            grouped = _by_address(hits.where(fetch["robots_blocked"]), "resource_url", _say("kind=", F.col("kind"), " href=", F.col("href"), " blocked by robots.txt"))
            drafts = grouped.select(draft_struct(rule, F.col("key"), _say("robots.txt forbids ", F.col("key"), " that is used by ", F.col("referrers")), "Allow the resource where it should be fetched.", F.col("points")).alias("d")).select("d.*")
            out.append(Output([_resource_gate(ev, rule, hits, ~F.coalesce(fetch["robots_known"], F.lit(False)))], [drafts]))
    target = F.coalesce("destination", "href")
    entity = _say(ident, " -> ", target, " #", F.col("seq").cast("string"))
    order = _say(ident, "\t", F.lpad(F.col("seq").cast("string"), 9, "0"))
    if "images.missing_alt" in wanted:
        spec = Spec("images.missing_alt", F.col("alt").isNull(), entity, _say("The image ", target, " has no alt text."), "Describe the image, or mark it as decoration by an empty alt text.", [pointer(ident, "img_alt", _say("href=", F.col("href"), " alt=missing"))], F.col("kind") == "image", None, order)
        out.append(evaluate_specs(ev.resources, [spec], ev.page_counts, "n_complete"))
    if "https.mixed_content" in wanted:
        rows = ev.resources.where(U.scheme_of(ident) == "https")
        spec = Spec("https.mixed_content", U.scheme_of(target) == "http", entity, _say("The secure page loads ", target), "Load resources over HTTPS.", [pointer(ident, "resource_url", _say("kind=", F.col("kind"), " href=", F.col("href")))], None, None, order)
        out.append(Output([_needs_https(ev, "https.mixed_content")], evaluate_specs(rows, [spec], ev.page_counts, "n_complete").drafts))
    return out


def _resource_gate(ev: Evidence, rule: str, hits: DataFrame, unknown: Column) -> DataFrame:
    one = hits.agg(F.count("*").alias("n"), F.count_if(unknown).alias("u")).join(F.broadcast(ev.page_counts))
    any_page = F.col("n_complete") > 0
    return gate_rows(one, rule, ~any_page | (F.col("n") > 0), any_page & (F.col("u") == 0))


BROKEN = {
    "images.broken_internal": ("same_host", ["image"], "Image", "Repair or replace the image."),
    "resources.broken_internal_js_css": ("same_host", ["script", "style"], "Script or style", "Repair or replace the file."),
    "images.broken_external": ("other_host", ["image"], "Image", "Repair, replace or remove the image."),
    "resources.broken_external_js_css": ("other_host", ["script", "style"], "Script or style", "Repair, replace or remove the file."),
}


def evaluate(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    return links(ev, cfg, wanted) + resources(ev, cfg, wanted)


RULES = [
    "links.broken_internal", "links.broken_external", "links.external_http_403", "url.malformed_link", "links.url_too_long",
    "links.internal_outgoing_nofollow", "links.external_outgoing_nofollow", "links.non_descriptive_anchors",
    "links.missing_anchor_text", "links.resources_as_page_link", "https.https_links_to_http", *BROKEN,
    "resources.blocked_internal_robots", "resources.blocked_external_robots", "images.missing_alt", "https.mixed_content",
]
