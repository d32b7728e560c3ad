import pytest
from pyspark.sql import functions as F

from sitewarden import schemas
from sitewarden.functions import html
from sitewarden.operators import algebra, graph, near_duplicates
from sitewarden.operators.evidence import Evidence
from sitewarden.plans import baseline, catalogue, engine, history
from sitewarden.plans.config import AuditConfig, Profile
from sitewarden.sources import exchange
from sitewarden.sources.store import Store, within_quota
from sitewarden.streaming import admission

SITE = "https://audit.example"


def page(path, body="", head="", status=200, **more):
    doc = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width">{head}</head><body>{body}</body></html>'
    return html.extract(SITE + path, status, "text/html", [], doc.encode(), **more)


def url(path, state="fetched", depth=None, reason=""):
    return (SITE + path, SITE + path, state, reason, depth, True, False)


def site(spark, pages, urls=(), **more):
    known = spark.createDataFrame([], schemas.OBSERVATION).schema
    return Evidence(spark, spark.createDataFrame(pages, known), urls=spark.createDataFrame(list(urls), schemas.URL_RECORD), start_url=SITE + "/", **more)


def run(ev, *rules, config=None):
    report = engine.evaluate(ev, config, rules=rules)
    found = report.findings.where(F.col("rule_id").isin(*rules)).orderBy("rule_id", "entity_key").collect()
    return report.states, [r.entity_key for r in found], found


def test_state_algebra():
    assert algebra.resolve_state(True, False, False, False, True) == "unsupported"
    assert algebra.resolve_state(False, False, False, False, True) == "disabled"
    assert algebra.resolve_state(False, True, False, False, True) == "not_applicable"
    assert algebra.resolve_state(False, True, True, False, True) == "incomplete"
    assert algebra.resolve_state(False, True, True, True, True) == "findings"
    assert algebra.resolve_state(False, True, True, True, False) == "passed"
    assert algebra.blocked_by(["passed", "disabled"]) == "incomplete" and algebra.blocked_by([None]) == "unsupported" and algebra.blocked_by(["findings"]) is None
    assert algebra.checker_order({"b": ("a",), "a": (), "c": ("x",)}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        algebra.checker_order({"a": ("b",), "b": ("a",)})


def test_catalogue():
    assert len(catalogue.RULES) == 98
    severities = [r.severity for r in catalogue.RULES.values()]
    assert (severities.count("error"), severities.count("warning"), severities.count("notice")) == (39, 34, 25)
    kinds = [catalogue.coverage(r, engine.default_registry().families) for r in catalogue.RULES.values()]
    assert (kinds.count("checker"), kinds.count("engine"), kinds.count("specified_unregistered"), kinds.count("deferred")) == (73, 3, 12, 10)


def test_config_and_profile():
    cfg = AuditConfig(thresholds={"max_title_chars": "x", "min_title_chars": "5"}, enabled={"b": False})
    assert cfg.number("max_title_chars") == 60 and cfg.number("min_title_chars") == 5 and cfg.fingerprint() == "v1;e:b=0;t:max_title_chars=x,min_title_chars=5"
    assert Profile.read('name = "n"\nstart_url = "https://a/"\nexcluded_paths = ["/x"]').excluded_paths == ("/x",)
    for bad in ('name = "n"\nstart_url = "ftp://a/"', 'name = "n"\nstart_url = "https://a/"\nnope = 1', 'name = ""\nstart_url = "https://a/"'):
        with pytest.raises(ValueError):
            Profile.read(bad)


def test_titles(spark):
    ev = site(spark, [page("/a", head="<title>Same  title</title>"), page("/b", head="<title>Same title</title>"), page("/c"), page("/d", head="<title></title>"), page("/e", head="<title>x</title>", truncated=True)])
    states, keys, rows = run(ev, "meta.duplicate_title", "meta.missing_title", "meta.short_title")
    assert keys == ["title:Same title", f"{SITE}/c", f"{SITE}/d", f"{SITE}/a", f"{SITE}/b"]
    assert [e.observation_identity for e in rows[0].evidence] == [f"{SITE}/a", f"{SITE}/b"]
    assert states == {"meta.missing_title": "findings", "meta.duplicate_title": "findings", "meta.short_title": "findings"}


def test_gates(spark):
    nothing = site(spark, [page("/a", truncated=True)])
    states, keys, _ = run(nothing, "meta.missing_title", "meta.long_title", "links.broken_internal")
    assert set(states.values()) == {"incomplete"} and not keys
    states, _, _ = run(site(spark, [page("/a")]), "meta.long_title", "links.broken_internal", "images.missing_alt", "structured_data.invalid")
    assert states == {"meta.missing_title": "findings", "meta.long_title": "not_applicable", "links.broken_internal": "not_applicable", "images.missing_alt": "not_applicable", "structured_data.invalid": "not_applicable"}
    states, _, _ = run(site(spark, [page("/a")]), "meta.long_title", config=AuditConfig(enabled={"meta.missing_title": False}))
    assert states == {"meta.missing_title": "disabled", "meta.long_title": "incomplete"}


def test_broken_links_need_all_targets(spark):
    body = '<a href="/gone">g</a><a href="/ok#x">o</a><a href="/dead">d</a>'
    pages = [page("/", body), page("/ok"), page("/gone", status=404)]
    states, keys, _ = run(site(spark, pages, [url("/"), url("/ok")]), "links.broken_internal")
    assert states["links.broken_internal"] == "incomplete" and not keys
    states, keys, _ = run(site(spark, pages, [url("/"), url("/ok"), url("/dead", "failed", reason="DNS error")]), "links.broken_internal")
    assert keys == [f"{SITE}/ -> {SITE}/dead #2", f"{SITE}/ -> {SITE}/gone #0"]
    states, keys, _ = run(site(spark, pages, [url("/"), url("/dead", "failed", reason="HTTP 404 from server")]), "links.broken_internal")
    assert keys == [f"{SITE}/ -> {SITE}/gone #0"]


def test_graph_fixture(spark):
    """A diamond with a cycle behind it, and a page that nothing links to."""
    links = {"/": ["/a", "/b", "/cycle-a"], "/a": ["/deep"], "/b": ["/deep"], "/deep": ["/deeper"], "/deeper": ["/deepest"], "/deepest": [], "/cycle-a": ["/cycle-b"], "/cycle-b": ["/cycle-a"], "/lonely": []}
    pages = [page(p, "".join(f'<a href="{t}">x</a>' for t in to)) for p, to in links.items()]
    ev = site(spark, pages, [url(p, depth=0 if p == "/" else None) for p in links], sitemap_known=True, sitemap_done=True, sitemap_urls=spark.createDataFrame([(SITE + p, SITE + p, None, "s") for p in ("/lonely", "/a")], schemas.SITEMAP_URL))
    tree = graph.bfs(graph.navigation_edges(ev), SITE + "/")
    got = {r.node.removeprefix(SITE): (r.depth, (r.parent or "").removeprefix(SITE)) for r in tree.collect()}
    assert got["/deep"] == (2, "/a") and got["/cycle-b"] == (2, "/cycle-a") and got["/deepest"] == (4, "/deeper") and "/lonely" not in got
    states, keys, rows = run(ev, "crawl.depth_gt_3", "crawl.orphans_in_sitemaps")
    assert keys == [f"{SITE}/deepest", f"{SITE}/lonely"]
    assert rows[0].evidence[0].excerpt == "depth=4; path=" + " → ".join(SITE + p for p in ("/", "/a", "/deep", "/deeper", "/deepest"))
    _, keys, _ = run(ev, "crawl.only_one_incoming_internal")
    assert f"{SITE}/deep" not in keys and f"{SITE}/a" in keys and f"{SITE}/cycle-a" not in keys


def test_hreflang_return_links(spark):
    alt = lambda **to: "".join(f'<link rel="alternate" hreflang="{k}" href="{v}">' for k, v in to.items())
    pages = [page("/en", head=alt(en="/en", de="/de", fr="/fr")), page("/de", head=alt(de="/de", en="/en")), page("/fr", head=alt(fr="/fr"))]
    _, keys, rows = run(site(spark, pages), "hreflang.incorrect_links")
    assert keys == [f"{SITE}/en hreflang=fr -> {SITE}/fr"] and rows[0].evidence[1].excerpt == "fr -> /fr"
    states, keys, _ = run(site(spark, pages[:2]), "hreflang.incorrect_links")
    assert states["hreflang.incorrect_links"] == "incomplete" and not keys
    _, keys, _ = run(site(spark, [page("/x", head=alt(de="/x2")), page("/x2", head=alt(de="/x2", en="/x"))]), "hreflang.incorrect_links")
    assert f"{SITE}/x self-reference" in keys


def test_duplicate_content(spark):
    words = [f"word{i}" for i in range(60)]
    chrome = "shop home about contact imprint "
    article = " ".join(words)
    near = " ".join(words[:30] + ["other"] + words[31:])
    pages = [page("/1", chrome + article), page("/2", chrome + article), page("/3", chrome + "unique one " * 9), page("/4", "alpha " + " ".join(reversed(words))), page("/5", "beta " + " ".join(reversed(words)))]
    _, keys, rows = run(site(spark, pages), "content.duplicate")
    assert any(k.startswith("exact:") for k in keys) and [e.observation_identity for e in rows[0].evidence if e.field == "content_hash"] == [f"{SITE}/1", f"{SITE}/2"]
    votes = near_duplicates.simhash_udf.func(__import__("pandas").Series([near.split(), article.split()]))
    assert bin((int(votes[0]) ^ int(votes[1])) & (2**64 - 1)).count("1") <= 16


def test_suppression_and_dedupe(spark):
    ev = site(spark, [page("/a"), page("/b")])
    rules = spark.createDataFrame([(1, 1, "meta.missing_title", f"{SITE}/a", "r", 0, None), (2, 1, None, f"{SITE}/b", "r", 0, 5)], schemas.SUPPRESSION)
    report = engine.evaluate(ev, suppressions=rules, rules=["meta.missing_title"])
    assert {(r.entity_key, r.suppressed) for r in report.findings.collect()} == {(f"{SITE}/a", True), (f"{SITE}/b", False)}
    assert report.states["meta.missing_title"] == "findings"


def test_history(spark):
    profile = Profile("n", SITE + "/", excluded_paths=("/private",))
    before = engine.evaluate(site(spark, [page("/a"), page("/b"), page("/gone"), page("/private/x")]), rules=["meta.missing_title"])
    after = engine.evaluate(site(spark, [page("/a"), page("/b", head="<title>Now it has one</title>"), page("/c")]), rules=["meta.missing_title"])
    urls = spark.createDataFrame([url("/a"), url("/b"), url("/c"), url("/gone", "pending")], schemas.URL_RECORD)
    runs = [history.RunView(i, r.findings, r.outcomes, urls, profile) for i, r in ((1, before), (2, after))]
    deltas = history.compare_runs(*runs)
    got = {r.entity_key.removeprefix(SITE): r.change for r in deltas.collect()}
    assert got == {"/a": "persistent", "/b": "resolved", "/c": "new", "/gone": "not_rechecked", "/private/x": "out_of_scope"}
    counts = history.summarize(deltas).first()
    assert (counts.new, counts.rechecked_baseline, counts.total) == (1, 2, 5)
    assert [k for k, _ in history.compatibility_notes(*runs)] == ["incomplete_later_run"]


def test_baseline(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('﻿Check,URL,Row kind,New issues,Extra\n"Missing title",https://audit.example/a,entity,3,"a ""b"", c"\nMissing title,https://audit.example/z,entity,x,\n,,,,\nHTTP 4xx,,aggregate,1,\n', encoding="utf-8")
    rows = exchange.read_baseline(spark, str(path))
    got = {(r.source_check, r.entity_url, r.row_kind, r.new_issues) for r in rows.collect()}
    assert got == {("Missing title", "https://audit.example/a", "entity", 3), ("Missing title", "https://audit.example/z", "entity", None), ("HTTP 4xx", None, "aggregate", 1)}
    with pytest.raises(ValueError):
        exchange.read_baseline(spark, "x.xlsx")
    ev = site(spark, [page("/a")], [url("/a")])
    report = engine.evaluate(ev, rules=["meta.missing_title"])
    entities = baseline.classify_entities(rows, report.findings, ev.urls, Profile("n", SITE + "/"), True, True)
    assert {(r.entity_url, r.verdict) for r in entities.collect()} == {(f"{SITE}/a", "overlap"), (f"{SITE}/z", "unexplained")}
    classes = baseline.matrix(report, entities)
    assert {r.rule_id: r.matrix_class for r in classes.collect()}["meta.missing_title"] == "entity_miss_unexplained"
    assert baseline.replacement_claim(classes, {p: True for p in baseline.PREREQUISITES}) == "not_claimed"


def test_export(spark, tmp_path):
    ev = site(spark, [page("/a")], [url("/a")])
    report = engine.evaluate(ev, rules=["meta.missing_title"])
    rows = exchange.export_rows(report, ev.urls, 3)
    exchange.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().evidence == f"{SITE}/a#title: "
    exchange.write_json(report, ev.urls, 3, str(tmp_path / "json"))
    assert '"run_id": 3' in exchange.document(report, ev.urls, 3)
    with pytest.raises(ValueError):
        exchange.write_csv(rows.withColumn("fact", F.lit("Authorization: x")), str(tmp_path / "bad"))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ev = site(spark, [page("/a")], [url("/a")])
    report = engine.evaluate(ev, rules=["meta.missing_title"])
    store.persist_report(1, report, 10)
    store.persist_report(2, report, 11)
    store.persist_report(1, report, 12)
    assert store.read("findings", 1).count() == 1 and store.read("audit_evaluations", 1).count() == 2
    number = store.suppress(1, "meta.missing_title", None, "known", 5)
    assert store.active_suppressions(1).count() == 1
    store.revoke(1, number, "again", 6)
    assert store.active_suppressions(1).count() == 0
    with pytest.raises(ValueError):
        store.suppress(1, None, None, "x", 1)
    store.upsert("store_settings", 1, spark.createDataFrame([("k", "a", 1)], "key string, value string, version bigint"), ["key"], "version")
    store.upsert("store_settings", 1, spark.createDataFrame([("k", "b", 2)], "key string, value string, version bigint"), ["key"], "version")
    assert [r.value for r in store.read("store_settings", 1).collect()] == ["b"]


def test_quota_is_first_fit(spark):
    rows = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (1, 4, 1)], "g int, o int, n int")
    assert sorted(r.o for r in within_quota(rows, 100, "g", "o", "n").collect()) == [1, 3]


def test_admission(spark, tmp_path):
    offers = spark.createDataFrame([("a", "a", 2, True, False, None), ("a", "a#x", 1, False, True, None), ("b", "b", None, False, True, None), ("c", "c", 0, True, False, None), ("d", "d", 0, True, False, "Excluded subfolder")], admission.OFFER)
    got = {r.identity: (r.depth, r.via_website, r.via_sitemap, r.state, r.reason) for r in admission.admit(offers, 2, 1).collect()}
    assert got == {"a": (1, True, True, "pending", "Queue cap"), "b": (None, False, True, "pending", "URL cap"), "c": (0, True, False, "pending", ""), "d": (0, True, False, "excluded", "Excluded subfolder")}
    source = str(tmp_path / "offers")
    offers.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(offers.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = admission.follow_offers(stream, str(tmp_path / "state"))
    query.awaitTermination()
    last = max((tmp_path / "state" / "merged").iterdir(), key=lambda p: int(p.name))
    assert spark.read.parquet(str(last)).count() == 4


def test_structured_and_https(spark):
    ld = '<script type="application/ld+json">{"@type": "Offer", "price": 1}</script>'
    ev = site(spark, [page("/a", '<img src="http://audit.example/i.png"><a href="http://audit.example/x">x</a>', head=ld)], now=1000, tls_inspections=spark.createDataFrame([("audit.example", 443, True, True, False, 0, 1000 + 86400 * 3, ["*.audit.example"], None)], schemas.TLS_INSPECTION))
    _, keys, _ = run(ev, "structured_data.invalid")
    assert keys == [f"{SITE}/a jsonld[0].availability search", f"{SITE}/a jsonld[0].priceCurrency"]
    _, keys, _ = run(ev, "https.mixed_content", "https.https_links_to_http", "https.certificate_expiry", "https.certificate_name")
    assert keys == ["audit.example:443", "audit.example:443", f"{SITE}/a -> http://audit.example/x #0", f"{SITE}/a -> http://audit.example/i.png #0"]


def test_responses_and_sql_functions(spark, tmp_path):
    from sitewarden.functions import register
    from sitewarden.sources import responses

    (tmp_path / "site" / "d").mkdir(parents=True)
    (tmp_path / "site" / "index.html").write_text("<title>Home</title>")
    (tmp_path / "site" / "d" / "a.html").write_text("<title>A</title>" + "x" * 100)
    rows = responses.from_files(spark, str(tmp_path / "site"), SITE, max_bytes=50)
    found = {r.identity: (r.page.titles, r.page.flags.truncated) for r in html.observations(rows).collect()}
    assert found == {f"{SITE}/": (["Home"], False), f"{SITE}/d/a.html": (["A"], True)}
    assert "url_identity" in register.register(spark)
    assert spark.sql("select url_identity('HTTP://A.example:80/x#y')").first()[0] == "http://a.example/x"


def test_settled_relations_change_nothing(spark):
    pages = [page("/", '<a href="/gone">g</a><img src="/i.png">'), page("/gone", status=404), page("/t", head="<title>A title that is long enough here</title>")]
    few, many = (site(spark, pages, [url(p, depth=0 if p == "/" else 1) for p in ("/", "/gone", "/t")]) for _ in range(2))
    many.settle()
    rules = ["links.broken_internal", "meta.missing_title", "images.missing_alt", "crawl.http_4xx"]
    assert run(few, *rules)[1] == run(many, *rules)[1] != []


def test_robots_decisions(spark):
    from sitewarden.functions import robots

    urls = spark.createDataFrame([("/a",), ("/b",)], "identity string")
    group = robots.select_group(robots.parse("User-agent: *\nDisallow: /a"), "bot")
    said = lambda *args, **more: {r.identity: (r.allowed, r.reason) for r in robots.decisions(urls, *args, F.col("identity"), **more).collect()}
    assert said("fetched", group) == {"/a": (False, "Disallow: /a"), "/b": (True, "no rule")}
    assert said("fetched", group, bypass=True)["/a"] == (True, "bypassed Disallow: /a")
    assert said("unavailable", None)["/a"] == (True, "robots.txt unavailable")


def test_navigation_links():
    markup = '<base href="/d/"><h1><a href="x">x</a></h1><!-- <a href="no"> --><script><a href="no"></script><a>none</a><a href=" ">e</a>'
    assert html.navigation_links(markup, SITE + "/") == [("x", f"{SITE}/d/x"), (" ", None)]
