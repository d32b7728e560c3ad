from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitewarden.functions import html, jsonld, robots, sitemaps
from sitewarden.functions import text as T
from sitewarden.functions import urls as U
from sitewarden.operators import near_duplicates


def test_url_identity():
    assert U.identity("HTTPS://Shop.Example:443/a/../b/./c?x=1#top") == "https://shop.example/b/c?x=1"
    assert U.identity("http://shop.example") == "http://shop.example/"
    assert U.identity("http://shop.example:8080/ä b") == "http://shop.example:8080/%C3%A4%20b"
    assert U.identity("not a url") == "not a url"
    assert U.identity("http://[bad") == "http://[bad"


def test_resolve():
    base = "https://a.example/x/y?q=1"
    for href, want in {"z": "https://a.example/x/z", "../z#f": "https://a.example/z", "/z?b": "https://a.example/z?b", "//b.example/z": "https://b.example/z", "?c=2": "https://a.example/x/y?c=2", "mailto:x@y": "mailto:x@y", "  ": None, "http://[bad": None, "\\z": "https://a.example/z"}.items():
        assert U.resolve(base, href) == want, href


def test_url_columns_agree_with_python(spark):
    raw = ["https://a.example/x#y", "https://a.example/x/../y", "HTTP://A.example", "https://a.example", "https://a.example?x#y", "x", None, "https://a.example/a_b?c=1&d=2#e", "https://a.example/%7e"]
    rows = spark.createDataFrame([(r,) for r in raw], "u string").select("u", U.identity_of(F.col("u")).alias("i"), U.resolve_of(F.lit("https://b.example/d/"), F.col("u")).alias("r")).collect()
    for r in rows:
        assert r.i == U.identity(r.u)
        assert r.r == U.resolve("https://b.example/d/", r.u)


def test_names_include_host():
    assert U.names_include_host(["*.example.com"], "a.example.com")
    assert not U.names_include_host(["*.example.com"], "fooexample.com")
    assert not U.names_include_host(["*.example.com"], "a.b.example.com")
    assert U.apex_and_www("www.a.example") == ("a.example", "www.a.example")
    assert U.apex_and_www("10.0.0.1") is None


def test_without_parameters():
    assert U.without_parameters("https://a.example/?a=1&b=2&a=3", ["a"]) == "https://a.example/?b=2"
    assert U.without_parameters("https://a.example/?A=1", ["a"], case_sensitive=False) == "https://a.example/"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8))
def test_fnv_and_collapse_agree_with_python(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.hex64(T.fnv1a64(F.col("w"))).alias("h")).collect()
    for r in rows:
        assert int(r.h, 16) == near_duplicates._fnv(r.w)


def test_text_functions(spark):
    r = spark.createDataFrame([("  Ab cÉ  d\n",)], "t string").select(T.collapse(F.col("t")).alias("c"), T.tokens(F.col("t")).alias("w"), T.shingles(T.tokens(F.col("t")), 2).alias("s"), T.shingles(T.tokens(F.col("t")), 4).alias("n"), T.neutralise_formula(F.lit("=1")).alias("f")).first()
    assert (r.c, r.w, r.s, r.n, r.f) == ("Ab cÉ d", ["ab", "cÉ", "d"], ["ab cÉ", "cÉ d"], [], "'=1")


PAGE = b"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title> A &amp; B </title><title></title>
<meta name="Description" content="d1"><meta name="robots" content="NOINDEX, follow"><meta name=viewport content="width=1">
<link rel="canonical" href="/c"><link rel=alternate hreflang=de href="/de"><link rel="stylesheet" href="//cdn.example/s.css">
<script type="application/ld+json">{"@type": "Offer"}</script><script src="x.js"></script><!-- <a href="no">no</a> --></head>
<body><nav>menu <a href="/n">N</a></nav><h1>H <a href="/in-heading">one</a></h1><a href="p?x=1#f" rel="nofollow">go <img src="in.png" alt="pic"></a>
<a href="/alt"><img src="i.png" alt="Alt"></a><img src="o.png"><img src="e.png" alt=""><area href="/area" alt="Ar"><a href="mailto:x@y">m</a>
<div itemscope itemtype="https://schema.org/Thing"></div><p>Body &nbsp; text</p><object></object></body></html>"""


def test_extract():
    o = html.extract("https://a.example/d/", 200, "text/html", [("X-Robots-Tag", "none"), ("Link", '<https://a.example/h>; rel="canonical", </fr>; rel=alternate; hreflang="fr"')], PAGE)
    p = o["page"]
    assert p["titles"] == ["A & B", ""] and p["descriptions"] == ["d1"] and p["html_lang"] == "en" and p["doctype"] == "html"
    assert p["robots_meta"] == ["NOINDEX, follow"] and p["robots_headers"] == ["none"] and p["viewport"] == "width=1"
    assert p["canonicals"] == ["https://a.example/h", "/c"] and [h["lang"] for h in p["hreflangs"]] == ["fr", "de"]
    assert [x["href"] for x in o["links"]] == ["/n", "p?x=1#f", "/alt", "/area", "mailto:x@y"]
    assert o["links"][1]["destination"] == "https://a.example/d/p?x=1#f" and o["links"][1]["rel"] == "nofollow" and o["links"][1]["anchor"] == "go"
    assert o["links"][2]["anchor"] == "Alt" and o["links"][4]["host_owner"] == "opaque"
    assert [(r["kind"], r["alt"]) for r in o["resources"]] == [("style", None), ("script", None), ("image", None), ("image", "")]
    assert o["resources"][0]["host_owner"] == "other_host"
    assert [(s["format"], s["index"]) for s in p["structured"]] == [("json_ld", 0), ("microdata", 0)]
    assert "menu" not in p["text"] and "Body text" in p["text"] and p["has_plugin_markup"] and not p["has_frames"]
    assert p["headings"] == [{"level": 1, "text": "H one"}]


def test_decoding():
    assert html.decode_body("text/html; charset=latin1", b"\xe9")[:2] == ("é", "windows-1252")
    assert html.decode_body("text/html", b"\xe9") == ("é", "windows-1252", True, False)
    assert html.decode_entities("&lt;&#65;&#x42;&euro;&amp;lt;") == "<AB&euro;&lt;"
    assert html.extract("https://a.example/", 200, "application/json", [], b"{}")["page"]["flags"]["non_html"]


def test_robots():
    p = robots.parse("User-agent: bot\nDisallow: /a\nAllow: /a/b\n\nUser-agent: *\nDisallow: /\nx: y\nSitemap: https://s\nno colon\n")
    assert len(p["groups"]) == 2 and p["sitemaps"] == ["https://s"] and len(p["errors"]) == 2
    group = robots.select_group(p, "BotX")
    assert robots.decide(group, "/a/c") == (False, "/a") and robots.decide(group, "/a/b/c") == (True, "/a/b") and robots.decide(group, "/z")[0]
    assert robots.decide(robots.select_group(p, "other"), "/z") == (False, "/")
    tie = {"rules": [{"allow": False, "pattern": "/p"}, {"allow": True, "pattern": "/p"}]}
    assert robots.decide(tie, "/p")[0]
    assert robots.decide({"rules": [{"allow": False, "pattern": "/*.php$"}]}, "/x.php")[0] is False
    assert robots.decide({"rules": [{"allow": False, "pattern": "/*.php$"}]}, "/x.php?a")[0]
    assert robots.product_token("Bot/1.0 (x)") == "Bot"


def test_sitemaps(spark):
    import gzip

    doc = '<?xml version="1.0"?><x:urlset><x:url><x:loc> https://a/?a&amp;b </x:loc></x:url></x:urlset>'
    assert sitemaps.parse(doc) == ("urlset", ["https://a/?a&b"])
    assert sitemaps.parse("<html></html>") is None and sitemaps.parse("<urlset><url>") is None
    assert sitemaps.inflate(gzip.compress(b"x" * 10)) == b"x" * 10 and sitemaps.inflate(gzip.compress(b"x" * 100), 50) is None
    index = "<sitemapindex><sitemap><loc>https://a/1</loc></sitemap><sitemap><loc>https://a/0</loc></sitemap><sitemap><loc>https://b/</loc></sitemap></sitemapindex>"
    docs = spark.createDataFrame([("https://a/0", index.encode()), ("https://a/1", doc.encode())], "url string, body binary")
    files, urls = sitemaps.walk(docs, ["https://a/0"], "https://a/")
    assert [f["state"] for f in files] == ["fetched", "fetched", "cycle", "cross_origin"] and [u["original"] for u in urls] == ["https://a/?a&b"]


def test_structured_data():
    keys = lambda raw: [i[0] for i in jsonld.issues("json_ld", 0, raw, [])]
    assert keys("{") == ["jsonld[0] syntax"] and keys(" ") == ["jsonld[0] syntax"] and keys("[]") == ["jsonld[0] syntax"] and keys("3") == ["jsonld[0] syntax"]
    assert keys('{"@type": "Product", "name": "n", "image": "i", "offers": {"@type": "Offer", "price": 1, "priceCurrency": "E", "availability": "x"}}') == []
    assert keys('{"@type": "Product"}') == ["jsonld[0].name", "jsonld[0].image search", "jsonld[0].offers|review|aggregateRating search"]
    assert keys('{"@graph": [{"@type": "https://schema.org/Organization", "name": "n", "url": "u"}, {"@type": "Recipe"}]}') == ["jsonld[0]/@graph/1 type=Recipe"]
    assert keys('{"@type": "Thing"}') == ["jsonld[0] type=Thing"] and keys("{}") == ["jsonld[0] type=(missing @type)"]
    assert keys('{"@type": "BreadcrumbList", "itemListElement": [{"@type": "ListItem", "name": "a", "position": 1}, {"name": "b", "position": 2}]}') == ["jsonld[0]/itemListElement/0.item search"]
    assert jsonld.issues("rdfa", 2, "", ["Thing"]) == [("rdfa[2] format", "rdfa[2]", "RDFa is listed, not validated", "Thing")]
