"""Odd and hostile inputs of the parsers, and the graph and fingerprint operators against brute force."""

import random

import pytest

from sitewarden import schemas
from sitewarden.functions import html, jsonld, robots, sitemaps
from sitewarden.operators import graph, near_duplicates


def keys(raw):
    return [i[0] for i in jsonld.issues("json_ld", 0, raw, [])]


@pytest.mark.parametrize("raw", ["[" * 200_000, "[" * 129 + "]" * 129, '{"a":' * 5000 + "1" + "}" * 5000, '{"@type": "Offer", "price": NaN}', "[Infinity]", "-Infinity"])
def test_json_that_no_parser_should_take(raw):
    assert keys(raw) == ["jsonld[0] syntax"]


def test_json_depth_counts_brackets_outside_of_strings():
    text = '{"@type": "Organization", "name": "' + "[{" * 300 + '\\"[", "url": "u"}'
    assert keys(text) == []
    assert keys("[" * 128 + "]" * 128) == ["jsonld[0]" + "/0" * 127 + " syntax"]


def test_offers_and_trails_at_any_place():
    assert keys('{"@type": "Product", "name": "n", "image": {"contentUrl": "u"}, "offers": [[], "x", {"price": 1}, {"@type": "Thing"}, {"@type": "Car"}]}') == [
        "jsonld[0]/offers/1.@id-reference",
        "jsonld[0]/offers/2 type=(missing @type)",
        "jsonld[0]/offers/2.priceCurrency",
        "jsonld[0]/offers/2.availability search",
        "jsonld[0]/offers/4 type=Car",
    ]
    assert keys('{"@type": "BreadcrumbList", "itemListElement": []}') == ["jsonld[0].itemListElement"]
    assert keys('{"@type": "BreadcrumbList", "itemListElement": ["x", {"name": "a", "position": 2}]}') == ["jsonld[0]/itemListElement/0.object"]
    assert keys('{"@type": ["Product", "Offer"], "name": "n", "price": 1}') == ["jsonld[0].image search", "jsonld[0].offers|review|aggregateRating search", "jsonld[0].priceCurrency", "jsonld[0].availability search"]


def test_responses_without_status_headers_or_body(spark):
    rows = spark.createDataFrame([("https://a/", None, None, None, None, None, None), ("nonsense", 200, "text/html", [], b"<title>x</title>", False, 3)], "url string, status int, content_type string, headers array<struct<name:string,value:string>>, body binary, truncated boolean, duration_ms long")
    got = {r.identity: r.page for r in html.observations(rows).collect()}
    assert got["https://a/"].flags.error_status and got["https://a/"].status is None and got["https://a/"].raw_bytes == 0
    assert got["nonsense"].titles == ["x"] and not got["nonsense"].flags.error_status


def test_robots_lines_end_at_line_feeds_only():
    found = robots.parse("User-agent: *\r\nDisallow: /a b\x0cc\x85d\r\nno colon\r\n")
    assert found["groups"][0]["rules"] == [{"allow": False, "pattern": "/a b\x0cc\x85d"}] and found["errors"] == ["Line 3: no colon in 'no colon'"]


def test_sitemap_files_are_taken_in_queue_order(spark):
    """An index of more files than allowed: the first ones are taken whatever order the table has; a null body is none."""
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>/{i}.xml</loc></sitemap>" for i in range(100)) + "</sitemapindex>"
    leaf = "<urlset><url><loc>https://a/p{}</loc></url></urlset>"
    rows = [("https://a/index.xml", index.encode())] + [(f"https://a/{i}.xml", leaf.format(i).encode()) for i in range(100) if i != 5]
    rows[20] = (rows[20][0], None)
    random.seed(1)
    random.shuffle(rows)
    files, urls = sitemaps.walk(spark.createDataFrame(rows, "url string, body binary"), ["https://a/index.xml", "mailto:x", "https://b/", "https://A/index.xml#x"], "https://a/")
    assert [f["state"] for f in files[:4]] == ["fetched", "cross_origin", "cross_origin", "cycle"] and files[0]["listed_urls"] == 100
    states = {f["url"]: f["state"] for f in files[4:]}
    assert [u["original"] for u in urls] == [f"https://a/p{i}" for i in range(60) if states[f"/{i}.xml"] == "fetched"]
    assert states["/5.xml"] == "inaccessible" and sorted(set(states.values())) == ["capped", "fetched", "inaccessible", "parse_error"]
    assert [s == "capped" for s in states.values()] == [False] * 60 + [True] * 40


def brute_bfs(edges, root):
    depth, order, parent = {root: 0}, [root], {root: None}
    for node in order:
        for other in sorted(d for s, d in edges if s == node):
            if other not in depth:
                depth[other], parent[other] = depth[node] + 1, node
                order.append(other)
    return depth, parent


def test_bfs_and_paths_against_brute_force(spark):
    random.seed(2)
    edges = {(f"n{random.randrange(40)}", f"n{random.randrange(40)}") for _ in range(70)} | {(f"c{i}", f"c{i + 1}") for i in range(37)} | {("n0", "c0")}
    edges = {(a, b) for a, b in edges if a != b}
    tree = graph.bfs(spark.createDataFrame(sorted(edges), "src string, dst string"), "n0")
    depth, parent = brute_bfs(edges, "n0")
    rows = tree.collect()
    assert {r.node: (r.depth, r.parent) for r in rows} == {n: (depth[n], parent[n]) for n in depth}
    got = {r.node: r.path for r in graph.paths(tree, tree.where("depth > 1")).collect()}
    for node in (n for n in depth if depth[n] > 1):
        path = [node]
        while parent[path[0]] is not None:
            path.insert(0, parent[path[0]])
        assert got[node] == path
    with pytest.raises(RuntimeError):
        graph.bfs(spark.createDataFrame(sorted(edges), "src string, dst string"), "n0", max_depth=5)


@pytest.mark.parametrize("most", [0, 1, 3, 6, 12])
def test_near_pairs_against_brute_force(spark, most):
    random.seed(3)
    values = [random.getrandbits(64) for _ in range(15)]
    for _ in range(60):
        x = random.choice(values)
        for _ in range(random.randrange(8)):
            x ^= 1 << random.randrange(64)
        values.append(x)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    got = {(r.a, r.b, r.distance) for r in near_duplicates.near_pairs(spark.createDataFrame([(v,) for v in values * 2], "fp long"), most).collect()}
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b, far(a, b)) for a in values for b in values if a < b and far(a, b) <= most}


def test_one_hot_block_makes_few_pairs(spark):
    """Fingerprints that agree in one whole 16-bit part meet rarely, since keys have three blocks."""
    random.seed(4)
    rows = spark.createDataFrame([(random.getrandbits(47) << 16 | 77,) for _ in range(20_000)], "fp long")
    assert near_duplicates.near_pairs(rows, 3).count() < 20
    masks = near_duplicates.block_keys(3)
    assert len(masks) == 20 and min(m.bit_count() for m in masks) >= 30


def test_observation_schema_has_no_surprises(spark):
    assert html.observations(spark.createDataFrame([], "url string, status int, content_type string, headers array<struct<name:string,value:string>>, body binary, truncated boolean, duration_ms long")).schema == spark.createDataFrame([], schemas.OBSERVATION).schema


def test_settled_evidence_is_deleted(spark, tmp_path):
    from sitewarden.operators.evidence import Evidence
    from sitewarden.plans import engine

    rows = [("https://a/", 200, "text/html", [], b"<!doctype html><title>Short</title><h1>x</h1>", False, 1), ("https://a/b", 200, "text/html", [], b"<title>Short</title>", False, 1)]
    responses = spark.createDataFrame(rows, "url string, status int, content_type string, headers array<struct<name:string,value:string>>, body binary, truncated boolean, duration_ms long")
    ev = Evidence(spark, html.observations(responses), start_url="https://a/")
    report = engine.evaluate(ev)
    folders = list(ev.settled.values())
    jvm = spark._jvm.org.apache.hadoop.fs
    there = lambda f: jvm.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(f))
    assert len(folders) == 4 and all(map(there, folders))
    ev.close()
    assert not any(map(there, folders)) and report.states["heading.missing_h1"] == "findings"
    assert report.findings.where("rule_id = 'heading.missing_h1'").count() == 1 and ev.pages.count() == 2


def test_stored_runs_from_begin_to_finish(spark, tmp_path):
    from sitewarden.plans import stored
    from sitewarden.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    profile = 'name = "p"\nstart_url = "https://a/"\n'
    store.begin(1, profile, "https://a/", 5)
    with pytest.raises(ValueError):
        store.begin(2, profile, "https://a/", 6)  # one is running
    bodies = spark.createDataFrame([("https://a/", b"one"), ("https://a/b", b"two")], "identity string, body binary")
    store.append_in_order("raw_pages", 1, bodies, ["identity"])
    store.append_in_order("raw_pages", 1, spark.createDataFrame([("https://a/", b"three")], "identity string, body binary"), ["identity"])
    assert [r.seq for r in store.read("raw_pages", 1).orderBy("seq").collect()] == [0, 1, 2]
    assert store.html_body(1, "https://a/") == b"three" and store.html_body(1, "https://a/c") is None
    with pytest.raises(KeyError):
        stored.load_run(store, 9)
    store.mark_sitemap_done(1, 7)
    store.finish(1, False, True, None, 8)
    run = stored.load_run(store, 1)
    assert (run.status, run.completed, run.cancelled, run.evidence.sitemap_done, run.profile.start_url) == ("incomplete", False, True, True, "https://a/")
    report = stored.evaluate_stored(store, 1)
    assert store.read("rule_outcomes", 1).count() == len(report.states) and run.view().findings.count() == 0
    store.begin(2, profile, "https://a/", 9)
    store.finish(2, True, False, None, 10)
    stored.evaluate_stored(store, 2)
    deltas, notes = stored.compare_stored(store, 2, 1)
    assert [k for k, _ in notes] == ["incomplete_later_run"] and deltas.where("change = 'resolved'").count() == 0
    store.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).read("runs").count() == 2
    with pytest.raises(ValueError):
        store.backup(str(tmp_path / "copy"))


def test_commands_of_a_crawl(spark, tmp_path):
    """Start once, refuse a second start, resume with what came since, and keep every offer merged once."""
    from sitewarden.streaming import admission, control

    def put(rows):
        spark.createDataFrame(rows, admission.OFFER).coalesce(1).write.mode("append").parquet(str(tmp_path / "offers"))

    put([("a", "a", 2, True, False, None), ("b", "b", None, False, True, None)])
    stream = lambda: spark.readStream.schema(admission.OFFER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "offers"))
    crawl = control.Crawl(spark, str(tmp_path / "crawl"))
    assert not crawl.cancel() and crawl.events() == ([], 0)
    with pytest.raises(RuntimeError, match="no crawl"):
        crawl.resume(stream())
    crawl.start(stream())
    crawl.wait()
    assert crawl.events()[0][0] == (0, 2)
    with pytest.raises(RuntimeError, match="resume"):
        crawl.start(stream())
    put([("a", "a", 1, False, True, None)])
    put([("c", "c", 3, True, False, "left out")])
    crawl.resume(stream())
    crawl.wait()
    rows = spark.read.parquet(str(tmp_path / "crawl" / "merged" / "2")).collect()
    assert sorted((r.identity, r.depth, r.via_website, r.via_sitemap) for r in rows) == [("a", 1, True, True), ("b", None, False, True), ("c", 3, True, False)]
    crawl.resume(stream(), {"processingTime": "1 second"})
    with pytest.raises(RuntimeError, match="running"):
        crawl.resume(stream())
    assert crawl.active and crawl.cancel() and not crawl.active
