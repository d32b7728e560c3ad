"""Every query that has oracle SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(value):
    if value is None or pd.isna(value) is True:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, (tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_rule_has_a_query():
    from sitewarden.plans import engine

    names = entry.queries()
    assert all("rule_" + r.replace(".", "_") in names for r in engine.default_registry().families)


def test_html_extract_reads_whole_pages(spark, tmp_path):
    from sitewarden.plans import operator_queries

    page = "<html><body>" + "x" * (1 << 20) + '<h2>Late</h2><a href="/late">late</a></body></html>'
    spark.createDataFrame([(1, "https://a.example/", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    row = operator_queries.html_extract(spark, str(tmp_path)).first()
    assert (row.links, row.headings, row.raw_bytes) == (1, 1, len(page))


def test_pages_findings_of_pages_that_share_an_address(spark, tmp_path):
    from sitewarden.plans import operator_queries

    page = '<html><head><meta charset="utf-8"><title>{}</title></head><body><h1>x</h1></body></html>'
    spark.createDataFrame([(i, "https://a.example/", page.format(t)) for i, t in enumerate(("One", "Two", "Two"))], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = rows(operator_queries.pages_findings(spark, str(tmp_path)).toPandas())
    assert got == rows(con.sql(ORACLES["pages_findings"]).df())
    assert sum("meta.short_title" in r for r in got) == 3


def test_sitemap_locations_beyond_the_limit_of_a_crawl(spark, tmp_path):
    from sitewarden.plans import operator_queries

    for name in ("part", "supplier", "nation", "lineitem", "documents"):
        os.symlink(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select i as o_orderkey, 'F' as o_orderstatus from range(100000, 140000) x(i)) to '{tmp_path}/orders.parquet'")
    for name in ("part", "supplier", "orders"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet')")
    got = operator_queries.sitemap_locations(spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(ORACLES["sitemap_locations"]).df())
    assert got.n.max() >= 40000


def test_links_of_the_site_are_rows_of_their_own(spark):
    """The page of all entries has links in proportion to the site: no row may hold them all."""
    from sitewarden.plans import rule_queries
    from sitewarden.sources import derived

    site = rule_queries.site(spark, FOLDER, False)
    assert site.observations.selectExpr("max(size(links) + size(resources))").first()[0] == 0
    links = derived.views(spark, FOLDER, "v_links")["v_links"]
    assert site.all_links.count() == links.count()
    assert site.whole_observations.selectExpr("sum(size(links))").first()[0] == links.count()
    counts = site.counted(site.pages).select("identity", "n_links").where("n_links > 0")
    assert counts.exceptAll(links.groupBy("identity").count()).isEmpty() and counts.count() == links.select("identity").distinct().count()


def test_only_odd_addresses_meet_python(spark):
    from sitewarden.functions import urls as U
    from sitewarden.plans import rule_queries

    rows = spark.createDataFrame([(1, "https://a.example/x#top"), (2, "HTTP://A.example/../x"), (3, None), (4, "mailto:z"), (5, "https://a.example/x?a=1&b=2")], "n int, url string")
    url, base = F.col("url"), F.lit("https://a.example/y/")
    pairs = ((U.with_identity(rows, url, "k"), U.identity_of(url)), (U.with_resolved(rows, base, url, "k"), U.resolve_of(base, url)))
    for found, same in pairs:
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.withColumn("k", same).collect()))
    site = rule_queries.site(spark, FOLDER, False)
    plan = site.of_complete("links")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("ArrowEvalPython", 1)
    assert "Union" in above and "NOT" in "".join(below.splitlines()[1:4])


def test_findings_of_a_rule_do_not_meet_in_one_task(spark):
    """A join of outcomes and findings on rule_id would bring all findings of a rule together."""
    from sitewarden.plans import engine, rule_queries

    report = engine.evaluate(rule_queries.site(spark, FOLDER, False), rules=["links.missing_anchor_text", "meta.frames"])
    flat = engine.rows_of(report)
    assert "Join" not in flat._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.rule_id, r.state, r.n) for r in flat.groupBy("rule_id", "state").agg(F.count("entity_key").alias("n")).collect()}
    counts = {r["rule_id"]: r["count"] for r in report.findings.groupBy("rule_id").count().collect()}
    assert found == {(r, s, counts.get(r, 0)) for r, s in report.states.items()}


def test_link_rules_join_targets_only_where_they_look_at_them(spark):
    from sitewarden.plans import link_rules, rule_queries
    from sitewarden.plans.config import AuditConfig

    site = rule_queries.site(spark, FOLDER, False)
    for rule, joins in (("links.missing_anchor_text", 1), ("links.external_outgoing_nofollow", 1), ("links.broken_internal", 3)):
        (out,) = link_rules.links(site, AuditConfig(), {rule})
        assert out.drafts[0]._jdf.queryExecution().optimizedPlan().toString().count("Join ") >= joins
        assert ("ArrowEvalPython" in out.drafts[0]._jdf.queryExecution().optimizedPlan().toString()) == (joins > 1)


def test_opaque_addresses_and_none_stay_in_the_jvm(spark):
    from sitewarden.functions import urls as U

    urls = ["mailto:z#x", "data:,a?b#c", "tel:", "x:y z", "MAILTO:z", "http:x", "ftp://A/", "mailto:ü", "a.b+c-1:?", None, "https://a.example/x#t", "nothing"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    found = U.with_identity(rows, F.col("url"), "k")
    assert sorted(map(str, found.collect())) == sorted(str(spark.createDataFrame([(u, U.identity(u))], "url string, k string").first()) for u in urls)
    plan = U.with_identity(spark.range(1).selectExpr("string(id) as url"), F.col("url"), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert U.OPAQUE in plan.split("ArrowEvalPython", 1)[1]


def test_sitemap_addresses_do_not_wait_for_python(spark):
    """There may be many more addresses in a sitemap than pages: canonicals are resolved before addresses and pages meet."""
    from sitewarden.plans import index_rules, rule_queries

    out = index_rules.sitemap_incorrect(rule_queries.site(spark, FOLDER, False))
    for rows in (*out.drafts, *out.gates):
        assert "ArrowEvalPython" not in rows._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[0]


def test_texts_are_read_once_for_the_language_rule(spark):
    """No text in a join or beside Python, and one split of it however often the result is looked at."""
    from sitewarden.plans import language_rules, rule_queries
    from sitewarden.plans.config import AuditConfig

    out = language_rules.mismatch(rule_queries.site(spark, FOLDER, True), AuditConfig())
    for frame in (*out.drafts, *out.gates):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan and "text#" not in plan
    texts = ["", None, "der die das und ich", "The this, THAT with é", "que los pas une", "une que", "x y z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", language_rules.detect(F.col("text")).alias("f"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    found = {r.i: r.f and (r.f.lang, r.f.hits, r.f.confidence) for r in rows.collect()}

    def brute(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = "".join(c if c.isalpha() else " " for c in words).split()
        hits = [(sum(w in own.split() for w in words), lang) for lang, own in language_rules.WORDS.items()]
        total = sum(n for n, _ in hits)
        return (max(hits)[1], max(hits)[0], max(hits)[0] / total) if total else None

    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_gate_of_a_lone_link_rule_joins_rows_in_scope_only(spark):
    """The internal links of the page of all entries must not meet in one task for a rule on external ones."""
    from sitewarden.plans import link_rules, rule_queries
    from sitewarden.plans.config import AuditConfig

    site = rule_queries.site(spark, FOLDER, False)
    (out,) = link_rules.links(site, AuditConfig(), {"links.external_outgoing_nofollow"})
    plan = out.gates[0]._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "= other_host" in line for line in plan.splitlines())
    scoped, all_rows = (out.gates[0].first(), link_rules.links(site, AuditConfig(), {"links.external_outgoing_nofollow", "links.url_too_long"})[0].gates[0].where("rule_id = 'links.external_outgoing_nofollow'").first())
    assert scoped == all_rows


def test_resource_rules_start_no_python_worker_for_plain_addresses(spark):
    from sitewarden.functions import urls as U
    from sitewarden.plans import link_rules, rule_queries
    from sitewarden.plans.config import AuditConfig

    def plan(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()

    site = rule_queries.site(spark, FOLDER, False)
    for rule in ("images.broken_external", "resources.blocked_external_robots"):
        (out,) = link_rules.resources(site, AuditConfig(), {rule})
        assert "EvalPython" not in plan(out.drafts[0]) + plan(out.gates[0])
    urls = ["https://a.example/x#t", "HTTPS://A.example:443/./b", "//x", None, "mailto:z#x", "https://b.example"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    odd = U.with_identity(rows, F.col("url"), "k", look=True)
    assert "EvalPython" in plan(odd)
    assert sorted(map(str, odd.collect())) == sorted(str(r) for r in U.with_identity(rows, F.col("url"), "k").collect())
    some = rows.where("url like '%#%'")
    assert "EvalPython" not in plan(U.with_identity(some, F.col("url"), "k", look=True))
    assert sorted(map(str, U.with_identity(some, F.col("url"), "k", look=True).collect())) == sorted(str(r) for r in U.with_identity(some, F.col("url"), "k").collect())
