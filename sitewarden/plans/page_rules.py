"""Rules that look at one page at a time, and duplicates of titles and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import text as T
from sitewarden.functions import urls as U
from sitewarden.operators.algebra import Output, Spec, draft_struct, evaluate_specs, gate_rows
from sitewarden.operators.evidence import Evidence, pointer
from sitewarden.plans.config import AuditConfig

DEPENDS = {
    "meta.duplicate_title": ("meta.missing_title",),
    "meta.long_title": ("meta.missing_title",),
    "meta.short_title": ("meta.missing_title",),
    "meta.duplicate_description": ("meta.missing_description",),
    "heading.h1_matches_title": ("meta.missing_title", "heading.missing_h1"),
    "meta.missing_viewport_width": ("meta.missing_viewport",),
}


def _say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def complete_page_specs(cfg: AuditConfig) -> list[Spec]:
    """Rules over complete pages."""
    ident = F.col("identity")
    title, description = T.first_non_empty(F.col("titles")), T.first_non_empty(F.col("descriptions"))
    h1s = F.filter("headings", lambda h: h["level"] == 1)
    h1 = F.try_element_at(F.filter(h1s, lambda h: h["text"] != ""), F.lit(1))["text"]
    max_title, min_title, max_bytes = cfg.number("max_title_chars"), cfg.number("min_title_chars"), cfg.number("max_html_bytes")
    max_links = cfg.number("max_on_page_links")
    width = F.col("viewport").rlike(r"(?i)(^|[,;])\s*width\s*=\s*[^\s,;]")

    def page(rule_id: str, where: Column, fact, recommendation: str, field: str, excerpt, scope: Column | None = None, more: list[Column] | None = None) -> Spec:
        return Spec(rule_id, where, ident, fact if isinstance(fact, Column) else F.lit(fact), recommendation, [pointer(ident, field, excerpt), *(more or [])], scope)

    def absent(values: Column, noun: str) -> Column:
        return F.when(F.size(values) == 0, f"The page has no {noun}.").otherwise(f"The page's {noun} is empty.")

    return [
        page("meta.missing_title", title.isNull(), absent(F.col("titles"), "title"), "Give the page one title that describes it.", "title", F.try_element_at("titles", F.lit(1))),
        page("meta.long_title", F.length(title) > max_title, _say("The title has ", F.length(title).cast("string"), " characters."), f"Keep titles within {max_title} characters.", "title", title, title.isNotNull()),
        page("meta.short_title", F.length(title) < min_title, _say("The title has ", F.length(title).cast("string"), " characters."), f"Write titles of at least {min_title} characters.", "title", title, title.isNotNull()),
        page("meta.missing_description", description.isNull(), absent(F.col("descriptions"), "meta description"), "Give the page a description of its own.", "description", F.try_element_at("descriptions", F.lit(1))),
        page("heading.missing_h1", F.size(h1s) == 0, "The page has no level-1 heading.", "Add a level-1 heading.", "h1", ""),
        page("heading.multiple_h1", F.size(h1s) > 1, _say("The page has ", F.size(h1s).cast("string"), " level-1 headings."), "Keep one level-1 heading.", "h1", F.array_join(F.transform(h1s, lambda h: h["text"]), " | ")),
        page("heading.h1_matches_title", T.collapse(title) == T.collapse(h1), "The title and the first level-1 heading say the same.", "Let the heading and the title differ where their roles do.", "title", T.collapse(title), title.isNotNull() & h1.isNotNull(), [pointer(ident, "h1", T.collapse(h1))]),
        page("meta.missing_viewport", F.col("viewport").isNull(), "The page has no viewport tag.", "Add a viewport tag with a width.", "viewport", ""),
        page("meta.missing_viewport_width", ~width, _say("The viewport names no width: ", _text(F.col("viewport"))), "Set a width such as width=device-width.", "viewport", F.col("viewport"), F.col("viewport").isNotNull()),
        page("meta.missing_charset", ~F.col("charset_declared"), "Neither the response nor the page declares a character set.", "Declare UTF-8; a byte order mark is no declaration.", "charset", F.col("encoding")),
        page("meta.missing_doctype", F.coalesce("doctype", F.lit("")) == "", "The page has no doctype.", "Begin with <!DOCTYPE html>.", "doctype", F.col("doctype")),
        page("meta.oversized_html", F.col("raw_bytes") > max_bytes, _say("The page has ", F.col("raw_bytes").cast("string"), " bytes."), f"Keep pages within {max_bytes} bytes.", "html_bytes", F.col("raw_bytes").cast("string")),
        page("meta.frames", F.col("has_frames"), "The page uses frames.", "Replace framesets by a layout.", "frameset_or_frame", "frameset/frame"),
        page("meta.incompatible_plugin_content", F.col("has_plugin_markup"), "The page embeds plugin content.", "Remove object, embed and applet elements.", "embed_object_applet", "object/embed/applet"),
        page("links.meta_refresh", F.size("meta_refresh") > 0, "The page refreshes itself by a meta tag.", "Redirect by HTTP instead.", "meta_refresh", F.array_join("meta_refresh", " | ")),
        page("links.too_many_on_page", F.col("n_links") > max_links, _say("The page has ", F.col("n_links").cast("string"), " links."), f"Keep pages within {max_links} links.", "anchor_href", F.col("n_links").cast("string")),
        page("hreflang.missing_hreflang_and_lang", F.col("in_crawl") & (F.trim(F.coalesce("html_lang", F.lit(""))) == "") & (F.size("hreflangs") == 0), "The page names no language.", "Set the lang attribute.", "html_lang", "html lang and hreflang absent"),
    ]


def observation_specs(ev: Evidence, cfg: AuditConfig) -> list[Spec]:
    """Rules over all observations."""
    ident, status = F.col("identity"), F.col("status")
    max_params, max_chars = cfg.number("max_query_params"), cfg.number("max_url_chars")
    own = F.when(status.isin(301, 302, 307, 308), status)
    first = F.coalesce(F.try_element_at("redirect_chain", F.lit(1))["status"], own)

    def obs(rule_id: str, where: Column, fact: Column, recommendation: str, field: str, excerpt) -> Spec:
        return Spec(rule_id, where, ident, fact, recommendation, [pointer(ident, field, excerpt)])

    return [
        obs("crawl.http_5xx", F.col("in_crawl") & status.between(500, 599), _say("The server answers ", status.cast("string"), "."), "Repair the page.", "http_status", status.cast("string")),
        obs("crawl.http_4xx", F.col("in_crawl") & status.between(400, 499), _say("The server answers ", status.cast("string"), "."), "Restore the page or remove links to it.", "http_status", status.cast("string")),
        obs("links.temporary_redirect", first.isin(302, 307), _say("The page redirects for now (", first.cast("string"), ")."), "Redirect permanently if the move is permanent.", "http_status", first.cast("string")),
        obs("links.permanent_redirects", first.isin(301, 308), _say("The page redirects for good (", first.cast("string"), ")."), "Link to the final address.", "http_status", first.cast("string")),
        obs("url.too_many_parameters", U.query_pairs(ident) > max_params, _say("The address has ", U.query_pairs(ident).cast("string"), " parameters."), f"Keep addresses within {max_params} parameters.", "url", ident),
        obs("url.underscores", F.contains(U.path_of(ident), F.lit("_")), F.lit("The path has an underscore."), "Prefer hyphens in paths.", "url", ident),
        obs("url.longer_than_200", F.length(ident) > max_chars, _say("The address has ", F.length(ident).cast("string"), " characters."), f"Keep addresses within {max_chars} characters.", "url", ident),
        obs("indexability.x_robots_noindex", F.col("header_noindex"), _say("The response forbids indexing: ", F.array_join("robots_headers", " | "), F.when(F.col("in_sitemap"), "; the sitemap lists the page.").otherwise("; the sitemap doesn't list the page.")), "Drop noindex where the page should be found.", "x_robots_tag", F.array_join("robots_headers", " | ")),
    ]


def redirects(ev: Evidence, cfg: AuditConfig) -> Output:
    """links.redirect_chains_loops: chains and loops of observations, and URL records that hit the redirect limit."""
    rule, limit = "links.redirect_chains_loops", cfg.number("max_redirects")
    hops = ev.pages.select("identity", "status", "redirect_chain")
    path = F.concat(F.array(F.try_element_at("redirect_chain", F.lit(1))["from"]), F.transform("redirect_chain", lambda h: h["to"]))
    plain = F.transform(path, lambda u: F.regexp_replace(u, "#.*$", ""))
    loop = (F.size("redirect_chain") > 0) & (F.size(F.array_distinct(plain)) < F.size(plain))
    chain = F.aggregate("redirect_chain", F.try_element_at("redirect_chain", F.lit(1))["from"], lambda s, h: F.concat(s, F.lit(" -"), h["status"].cast("string"), F.lit("-> "), h["to"]))
    found = hops.where(loop | (F.size("redirect_chain") > limit)).withColumn("chain", F.coalesce(chain, F.lit("no hops")))
    first = found.select(draft_struct(rule, F.col("identity"), _say(F.when(loop, "Redirects loop: ").otherwise("Redirects chain: "), F.col("chain")), "Redirect in one hop.", F.array(pointer("identity", "redirect_chain", F.col("chain"))), _say("0", F.col("identity"))).alias("d")).select("d.*")
    stopped = ev.urls.where("state = 'failed'").where(F.lower("reason").contains("exceeded the redirect limit")).withColumn("who", F.coalesce("identity", "original"))
    second = stopped.select(draft_struct(rule, F.col("who"), _say("Redirects were given up: ", F.col("reason")), "Redirect in one hop.", F.array(pointer("who", "redirect_chain", F.col("reason"))), _say("1", F.col("who"))).alias("d")).select("d.*")
    return Output([gate_rows(ev.page_counts, rule, True, (F.col("n_obs") > 0) | F.lit(ev.has_urls))], [first, second])


def duplicates(ev: Evidence, rule: str) -> Output:
    """Groups of complete pages with one normalised title (a finding each) or description (a finding for each page)."""
    column, label, per_page = ("titles", "title", False) if rule == "meta.duplicate_title" else ("descriptions", "description", True)
    value = T.first_non_empty(F.col(column))
    pages = ev.complete_pages.where(value.isNotNull()).select("identity", T.collapse(value).alias("value"))
    sizes = pages.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    members = pages.join(sizes, "value")
    points = members.groupBy("value", "n").agg(F.sort_array(F.collect_list(pointer("identity", label, F.col("value")))).alias("points"))
    fact = _say(F.col("n").cast("string"), f" pages share this {label}: ", F.col("value"))
    advice = f"Give each page a {label} of its own."
    if per_page:
        rows = members.select("identity", "value").join(points, "value")
        drafts = rows.select(draft_struct(rule, F.col("identity"), fact, advice, F.col("points")).alias("d")).select("d.*")
    else:
        drafts = points.select(draft_struct(rule, _say(f"{label}:", F.when(F.col("value") == "", "(empty)").otherwise(F.col("value"))), fact, advice, F.col("points")).alias("d")).select("d.*")
    return Output([gate_rows(ev.page_counts, rule, True, F.col("n_complete") > 0)], [drafts])


def evaluate(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    pages = ev.counted(ev.complete_pages) if "links.too_many_on_page" in wanted else ev.complete_pages
    out = [
        evaluate_specs(pages, [s for s in complete_page_specs(cfg) if s.rule_id in wanted], ev.page_counts, "n_complete"),
        evaluate_specs(ev.pages, [s for s in observation_specs(ev, cfg) if s.rule_id in wanted], ev.page_counts, "n_obs"),
    ]
    if "links.redirect_chains_loops" in wanted:
        out.append(redirects(ev, cfg))
    return out + [duplicates(ev, r) for r in ("meta.duplicate_title", "meta.duplicate_description") if r in wanted]


RULES = [
    "meta.missing_title", "meta.duplicate_title", "meta.long_title", "meta.short_title", "meta.missing_description",
    "meta.duplicate_description", "heading.missing_h1", "heading.multiple_h1", "heading.h1_matches_title",
    "meta.missing_viewport", "meta.missing_viewport_width", "meta.missing_charset", "meta.missing_doctype",
    "meta.oversized_html", "meta.frames", "meta.incompatible_plugin_content", "links.meta_refresh",
    "links.too_many_on_page", "hreflang.missing_hreflang_and_lang", "crawl.http_5xx", "crawl.http_4xx",
    "links.temporary_redirect", "links.permanent_redirects", "url.too_many_parameters", "url.underscores",
    "url.longer_than_200", "indexability.x_robots_noindex", "links.redirect_chains_loops",
]
