"""Rules on duplicate content, structured data and the navigation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewarden.functions import jsonld
from sitewarden.functions import urls as U
from sitewarden.operators import graph, near_duplicates
from sitewarden.operators.algebra import Output, draft_struct, gate_rows
from sitewarden.operators.evidence import Evidence, pointer
from sitewarden.plans.config import AuditConfig
from sitewarden.plans.page_rules import _say
from sitewarden.sources.tables import checkpoint


def duplicate_content(ev: Evidence, cfg: AuditConfig) -> Output:
    rule = "content.duplicate"
    blocked = ev.urls.where("state = 'blocked'").select(F.explode(F.array("original", "identity")).alias("identity")).where("identity is not null").distinct()
    rows = ev.complete_pages.join(blocked, "identity", "left_anti").select(F.col("identity").alias("id"), "text")
    one = rows.agg(F.count("*").alias("n"))
    found = near_duplicates.groups(rows, cfg.number("boilerplate_min_pages"), cfg.number("min_main_tokens"), cfg.number("near_duplicate_max_hamming"))
    name = F.when(F.col("method") == "exact", "exact_hash").otherwise("simhash")

    def points(m):
        hash_, method = pointer(m, "content_hash", F.col("fingerprint")), pointer(m, "method", name)
        return F.when(F.col("distance").isNull(), F.array(hash_, method)).otherwise(F.array(hash_, pointer(m, "simhash_hamming", F.col("distance").cast("string")), method))

    drafts = found.select(draft_struct(rule, _say(F.col("method"), ":", F.col("fingerprint")), _say(F.size("members").cast("string"), " pages share their main content."), "Give pages content of their own, or one canonical.", F.flatten(F.transform("members", points))).alias("d")).select("d.*")
    return Output([gate_rows(one, rule, True, F.col("n") > 0)], [drafts])


def structured(ev: Evidence) -> Output:
    rule = "structured_data.invalid"
    blocks = ev.complete_pages.select("identity", F.posexplode("structured").alias("pos", "block"))
    one = blocks.agg(F.count("*").alias("n")).join(F.broadcast(ev.page_counts))
    found = blocks.select("identity", "pos", F.posexplode(jsonld.issues_of(F.col("block"))).alias("i", "issue"))
    order = _say(F.col("identity"), "\t", F.lpad(F.col("pos").cast("string"), 6, "0"), F.lpad(F.col("i").cast("string"), 6, "0"))
    drafts = found.select(draft_struct(rule, _say(F.col("identity"), " ", F.col("issue.key")), F.col("issue.message"), "Correct the block; this check doesn't tell what search engines show.", F.array(pointer("identity", "", F.col("issue.excerpt")).withField("field", F.col("issue.path"))), order).alias("d")).select("d.*")
    any_page = F.col("n_complete") > 0
    return Output([gate_rows(one, rule, ~any_page | (F.col("n") > 0), any_page)], [drafts])


def navigation(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    if not wanted & {"crawl.depth_gt_3", "crawl.only_one_incoming_internal", "crawl.orphans_in_sitemaps"}:
        return []
    edges = checkpoint(graph.navigation_edges(ev))
    home = graph.homepage(ev)
    into = graph.inbound(edges)
    counts = ev.page_counts
    any_page = F.col("n_complete") > 0
    out = []
    rule = "crawl.depth_gt_3"
    if rule in wanted:
        drafts = []
        if home is not None:
            most = cfg.number("max_clicks")
            tree = graph.bfs(edges, home)
            deep = tree.where(F.col("depth") > most)
            rows = deep.join(graph.paths(tree, deep), "node").join(into, "node", "left")
            way = F.array_join("path", " → ")
            drafts = [rows.select(draft_struct(rule, F.col("node"), _say("The page is ", F.col("depth").cast("string"), " clicks from the homepage: ", way), f"Bring pages within {most} clicks.", F.array(pointer("node", "link_depth", _say("depth=", F.col("depth").cast("string"), "; path=", way)))).alias("d")).select("d.*")]
        out.append(Output([gate_rows(counts, rule, True, any_page & F.lit(home is not None))], drafts))
    rule = "crawl.only_one_incoming_internal"
    if rule in wanted:
        rows = into.where(F.col("node") != F.lit(home)) if home is not None else into
        drafts = rows.where("n = 1").select(draft_struct(rule, F.col("node"), _say("Only ", F.col("referrer"), " links to the page."), "Link to the page from another place.", F.array(pointer("node", "link_graph", _say("inbound=1 from ", F.col("referrer"))))).alias("d")).select("d.*")
        nodes = ev.pages.select("key").unionByName(ev.urls.where("identity is not null").select(U.identity_of(F.col("identity")).alias("key"))).unionByName(edges.select(F.col("dst").alias("key"))).distinct()
        one = rows.agg(F.count("*").alias("n")).join(F.broadcast(counts)).join(F.broadcast(nodes.agg(F.count("*").alias("k"))))
        nothing = F.col("n") == 0
        applicable = ~any_page | ~(nothing & F.lit(home is not None) & (F.col("k") <= 1))
        out.append(Output([gate_rows(one, rule, applicable, any_page & ~(nothing & F.lit(home is None)))], [drafts]))
    rule = "crawl.orphans_in_sitemaps"
    if rule in wanted:
        listed = ev.sitemap_urls.where("coalesce(skip_reason, '') = '' and identity is not null").select(U.identity_of(F.col("identity")).alias("node"), "source_sitemap")
        if home is not None:
            listed = listed.where(F.col("node") != F.lit(home))
        orphans = checkpoint(listed.groupBy("node").agg(F.min("source_sitemap").alias("source")).join(into, "node", "left_anti"))
        unsettled = not ev.sitemap_done or not ev.urls.where("state in ('pending', 'in_flight')").isEmpty() or not ev.pages.where("not complete").isEmpty()
        if unsettled:
            sums = orphans.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), " | ").alias("s")).where("n > 0")
            place = home or "sitemap"
            drafts = sums.select(draft_struct(rule, F.lit(f"{place} sitemap-orphan-candidates"), _say(F.col("n").cast("string"), " listed pages have no link yet; the crawl isn't complete."), "Finish the crawl and look again.", F.array(pointer(F.lit(place), "sitemap_url", _say("candidates=", F.col("n").cast("string"), "; sources=", F.col("s"))))).alias("d")).select("d.*")
        else:
            drafts = orphans.select(draft_struct(rule, F.col("node"), _say("No page links to the page that ", F.col("source"), " lists."), "Link to the page.", F.array(pointer("node", "sitemap_url", _say("source=", F.col("source"))))).alias("d")).select("d.*")
        one = ev.sitemap_urls.agg(F.count("*").alias("n")).join(F.broadcast(counts))
        out.append(Output([gate_rows(one, rule, F.lit(not ev.sitemap_known) | (F.col("n") > 0), F.lit(ev.sitemap_known) & (any_page | F.lit(ev.has_urls)))], [drafts]))
    return out


def evaluate(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    out = [duplicate_content(ev, cfg)] if "content.duplicate" in wanted else []
    if "structured_data.invalid" in wanted:
        out.append(structured(ev))
    return out + navigation(ev, cfg, wanted)


RULES = ["content.duplicate", "structured_data.invalid", "crawl.depth_gt_3", "crawl.only_one_incoming_internal", "crawl.orphans_in_sitemaps"]
