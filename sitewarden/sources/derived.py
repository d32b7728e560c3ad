"""A site derived from the star-schema test tables: SQL that Spark and DuckDB read alike.

Each entry of VIEWS is a common table expression over the tables and the ones before; STR stands for the string type.
site() turns them into the nested evidence, oracle queries read them flat."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden import schemas
from sitewarden.operators.evidence import Evidence
from sitewarden.sources.tables import materialised, table

NOW = 1_700_000_000
START = "https://shop.example/p/1"

VIEWS = {
    "v_keys": "select p_partkey as k, p_name, p_brand, p_type, p_size, (select count(*) from part) as n from part",
    "v_pages": """
select k, concat(case when k % 17 = 0 then 'http' else 'https' end, '://shop.example/p/', k,
    case when k % 13 = 0 then '_x' else '' end, case when k % 29 = 0 then '?a=1&b=2&c=3&d=4&e=5' else '' end,
    case when k % 211 = 0 then concat('/', repeat('y', 200)) else '' end) as identity,
  case when k % 19 = 3 then 404 when k % 19 = 7 then 500 when k % 19 = 11 then 301 when k % 19 = 13 then 302 else 200 end as status,
  k % 97 = 5 as truncated, false as non_html, 'text/html' as content_type,
  case when k % 23 = 0 then null when k % 23 = 1 then '' when k % 5 = 0 then concat(p_brand, '  ', p_type)
       when k % 5 = 1 then concat(p_name, ' ', k) else concat(p_name, ' ', p_brand, ' in ', p_type, ' quality, number ', k, ' of the range') end as title,
  case when k % 7 = 0 then null when k % 11 = 2 then concat(p_brand, ' ', p_type) else concat('About ', p_name, ' ', k) end as description,
  case when k % 13 = 0 then 0 when k % 13 = 1 then 2 else 1 end as n_h1,
  case when k % 6 = 0 then null when k % 6 = 1 then 'initial-scale=1' else 'width=device-width, initial-scale=1' end as viewport,
  k % 8 <> 0 as charset_declared, case when k % 9 = 0 then null when k % 9 = 1 then '' else 'html' end as doctype,
  case when k % 41 = 0 then 2000000 else 1000 + k % 5000 end as raw_bytes,
  k % 43 = 0 as has_frames, k % 47 = 0 as has_plugin, case when k % 37 = 0 then '5; url=/x' end as refresh,
  case when k % 3 = 0 then null when k % 12 = 1 then 'de-DE' else 'en' end as html_lang,
  case when k % 31 = 0 then 'noindex, nofollow' end as robots_header, case when k % 59 = 0 then 'NOINDEX' end as robots_meta,
  case when k % 19 = 11 or k % 19 = 13 then 1 + k % 2 else 0 end as n_hops, k % 38 = 11 as hops_loop,
  k % 101 = 9 as challenged, k % 103 = 8 as fallback
from v_keys
union all
select -1 - s_suppkey, concat('https://ext.example/s/', s_suppkey), case when s_nationkey % 5 = 0 then 403 when s_nationkey % 5 = 1 then 404 else 200 end,
  false, true, case when s_nationkey % 2 = 0 then 'application/pdf' else 'text/html; charset=utf-8' end,
  null, null, 0, null, true, null, 10, false, false, null, null, null, null, 0, false, false, false
from supplier""",
    "v_cp": "select * from v_pages where not truncated and status < 400 and not non_html and not challenged and not fallback",
    "v_urls": """
select identity as original, identity, 'fetched' as state, '' as reason, case when k = 1 then 0 when k between 2 and 9 then 1 end as click_depth from v_pages where k % 113 <> 50
union all
select concat('https://shop.example/o/', o_orderkey), concat('https://shop.example/o/', o_orderkey), case when o_orderstatus = 'P' then 'blocked' else 'failed' end,
  case when o_orderstatus = 'P' then 'Disallow: /o/' when o_orderstatus = 'F' then 'Connection failed' else 'HTTP 410 from server; exceeded the redirect limit' end, null
from orders""",
    "v_links0": """
select l_partkey as k, l_orderkey, l_linenumber, l_suppkey, l_returnflag,
  row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) - 1 as seq,
  (l_partkey * 7 + l_linenumber * 131 + l_orderkey) % (select count(*) from part) as t from lineitem""",
    "v_links": """
select p.identity, l.k, l.seq, l.l_linenumber as ln,
  case when l.l_linenumber = 7 then 'http://[bad' when l.l_linenumber = 5 then e.identity when l.l_linenumber = 6 and l.l_suppkey % 50 = 0 then concat('mailto:', repeat('z', 2100)) when l.l_linenumber = 4 then concat(t.identity, '#top') else t.identity end as href,
  case when l.l_linenumber = 7 then null when l.l_linenumber = 5 then e.identity when l.l_linenumber = 6 and l.l_suppkey % 50 = 0 then concat('mailto:', repeat('z', 2100)) when l.l_linenumber = 4 then concat(t.identity, '#top') else t.identity end as destination,
  case when l.l_linenumber = 7 then null when l.l_linenumber = 5 then e.identity when l.l_linenumber = 6 and l.l_suppkey % 50 = 0 then concat('mailto:', repeat('z', 2100)) else t.identity end as dest_key,
  case when l.l_linenumber = 1 then 'Click  Here' when l.l_linenumber = 2 then '  ' else concat('item ', l.l_suppkey) end as anchor,
  case when l.l_returnflag = 'R' then 'noopener NoFollow' else '' end as rel, case when l.l_linenumber = 6 then 'area' else 'a' end as element,
  case when l.l_linenumber = 7 or (l.l_linenumber = 6 and l.l_suppkey % 50 = 0) then 'opaque' when l.l_linenumber = 5 then 'other_host'
       when substring(p.identity, 1, 8) = substring(t.identity, 1, 8) then 'same_host' else 'other_host' end as host_owner
from v_links0 l join v_pages p on p.k = l.k join v_pages t on t.k = l.t join v_pages e on e.k = -1 - l.l_suppkey
union all
select h.identity, h.k, (select count(*) from v_links0 where k = 4) + 2 * t.k + x.n, 1, concat(t.identity, x.mark), concat(t.identity, x.mark), t.identity, concat('entry ', t.k), '', 'area',
  case when substring(h.identity, 1, 8) = substring(t.identity, 1, 8) then 'same_host' else 'other_host' end
from v_pages t join v_pages h on h.k = case when t.k >= 0 then 4 end join (select 0 as n, '' as mark union all select 1, '#top') x on true""",
    "v_resources": """
select p.identity, l.k, row_number() over (partition by l.k order by l.seq) - 1 as seq,
  case when l.l_linenumber = 1 then 'image' when l.l_linenumber = 2 then 'script' else 'style' end as kind,
  concat(case when l.l_returnflag = 'N' then 'https://shop.example/a/' else 'http://cdn.example/a/' end, l.l_suppkey, case when l.l_linenumber = 1 then '.png' else '.js' end) as destination,
  case when l.l_orderkey % 3 = 0 then null when l.l_orderkey % 3 = 1 then '' else 'a thing' end as alt,
  case when l.l_returnflag = 'N' then 'same_host' else 'other_host' end as host_owner
from v_links0 l join v_pages p on p.k = l.k""",
    "v_fetches": """
select concat(h.base, s_suppkey, x.ext) as identity, case when s_suppkey % 7 = 0 then 404 when s_suppkey % 7 = 1 then 403 when s_suppkey % 7 = 2 then null else 200 end as status,
  case when s_suppkey % 7 = 2 then 'DNS lookup failed' end as failed_reason, s_suppkey % 11 = 3 as challenge, s_suppkey % 13 = 4 as robots_blocked
from supplier cross join (select 'https://shop.example/a/' as base union all select 'http://cdn.example/a/') h cross join (select '.png' as ext union all select '.js') x""",
    "v_canonicals": """
select p.identity, p.k, 0 as pos, case when p.k % 50 = 7 then '  ' else t.identity end as href, case when p.k % 50 <> 7 then t.identity end as target
from v_pages p join v_pages t on t.k = case when p.k % 4 = 0 then p.k else (p.k * 3 + 1) % (select count(*) from part) end where p.k >= 0 and p.k % 5 = 2
union all
select p.identity, p.k, 1, t.identity, t.identity from v_pages p join v_pages t on t.k = (p.k + 11) % (select count(*) from part) where p.k >= 0 and p.k % 35 = 2""",
    "v_hreflangs": """
select p.identity, p.k, x.pos, case when x.pos = 2 and p.k % 33 = 1 then 'espanol' when x.pos = 2 and p.k % 44 = 1 then 'EN' else x.lang end as lang,
  case when x.pos = 0 and p.k % 55 <> 1 then p.identity else t.identity end as href
from v_pages p join (select 0 as pos, 'en' as lang, 0 as d union all select 1, 'de', 11 union all select 2, 'x-default', 22) x on true
join v_pages t on t.k = (p.k + x.d + case when x.pos = 0 then 11 else 0 end) % (select count(*) from part)
where p.k >= 0 and p.k % 11 = 1""",
    "v_sitemap_files": """
select 'https://shop.example/sitemap.xml' as url, 'fetched' as state, '' as reason, 60000 as listed_urls
union all select 'https://shop.example/broken.xml', 'parse_error', 'unexpected end', 0
union all select 'https://shop.example/lost.xml', 'inaccessible', 'HTTP 404', 0
union all select 'https://shop.example/big.xml', 'oversized', 'more than the limit', 10""",
    "v_sitemap_urls": """
select p.identity as original, p.identity, 'https://shop.example/sitemap.xml' as source_sitemap from v_pages p where p.k >= 0 and p.k % 3 = 0 and p.k % 113 <> 50
union all select concat('https://shop.example/o/', o_orderkey), concat('https://shop.example/o/', o_orderkey), 'https://shop.example/sitemap.xml' from orders""",
    "v_structured": """
select identity, k, 0 as pos, 'json_ld' as format, 0 as place, concat('{"@type":"Product","image":"x","name":"', k, '"}') as raw, '' as types from v_pages where k >= 0 and k % 7 = 2
union all select identity, k, 1, 'json_ld', 1, '{"@graph":[{"@type":"Organization","url":"u"},{"@type":"Recipe"}]}', '' from v_pages where k >= 0 and k % 7 = 2
union all select identity, k, 0, 'json_ld', 0, concat('{"name": ', k), '' from v_pages where k >= 0 and k % 7 = 4
union all select identity, k, 0, 'microdata', 0, '', 'Thing,Offer' from v_pages where k >= 0 and k % 7 = 5
union all select identity, k, 0, 'json_ld', 0, '{"price": NaN}', '' from v_pages where k >= 0 and k % 7 = 6""",
    "v_branch_robots": """
select concat('https://n', n_nationkey, '.example') as origin, case when n_nationkey % 2 = 0 then 'not_found' else 'fetched' end as fetch_kind,
  case when n_nationkey % 2 = 1 then 200 when n_regionkey = 0 then 410 else 404 end as fetch_status from nation""",
    "v_tls": """
select concat('n', n_nationkey, '.example') as host, 443 as port, n_nationkey % 6 <> 5 as inspected, n_nationkey % 4 = 0 as hostname_ok, 1700000000 + (n_nationkey - 8) * 200000 as not_after,
  case when n_nationkey % 3 = 0 then '*.example' else 'other.example' end as name from nation""",
    "v_text": "select p.identity, coalesce(d.text, '') as text from v_pages p left join documents d on d.doc_id = p.k where p.k >= 0",
}


def prelude(*names: str) -> str:
    """`with ...` for the named views and those that they need, for DuckDB."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in re.findall(r"\bv_\w+", VIEWS[name]):
            if other != name:
                add(other)
        if name not in need:
            need.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in need) + "\n"


def views(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The named views as DataFrames."""
    tables = {t: table(spark, folder, t) for t in ("part", "supplier", "orders", "lineitem", "nation", "documents")}
    made: dict[str, DataFrame] = {}

    def make(name: str) -> DataFrame:
        if name not in made:
            sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
            uses = {v: make(v) for v in dict.fromkeys(re.findall(r"\bv_\w+", sql))}
            used = {t: tables[t] for t in tables if re.search(rf"\b(from|join) {t}\b", sql)}
            for t in (*uses, *used):
                sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
            made[name] = spark.sql(sql, **uses, **used)
        return made[name]

    return {n: make(n) for n in names}


def site(spark: SparkSession, folder: str, text: bool = False) -> Evidence:
    """The evidence of the derived site; page texts only where asked for. Links and resources are flat: the page of all
    entries has two links for each page."""
    v = views(spark, folder, "v_pages", "v_urls", "v_links", "v_resources", "v_fetches", "v_canonicals", "v_hreflangs", "v_sitemap_files", "v_sitemap_urls", "v_tls", "v_text", "v_structured")

    def children(name: str, order: str, value) -> DataFrame:
        return v[name].groupBy("identity").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]).alias(name))

    null = F.lit(None).cast("string")
    links = v["v_links"].select("identity", F.col("seq").cast("int").alias("seq"), F.col("identity").alias("source"), "href", "destination", "anchor", "rel", "element", "host_owner")
    resources = v["v_resources"].select("identity", F.col("seq").cast("int").alias("seq"), F.col("identity").alias("referring"), "kind", F.col("destination").alias("href"), "destination", "alt", "host_owner")
    pages = v["v_pages"].join(children("v_canonicals", "pos", F.col("href")), "identity", "left").join(children("v_hreflangs", "pos", F.struct("lang", "href")), "identity", "left")
    kinds = F.when(F.col("types") != "", F.split("types", ",")).otherwise(F.array().cast("array<string>"))
    pages = pages.join(children("v_structured", "pos", F.struct("format", F.col("place").cast("int").alias("index"), "raw", kinds.alias("types"))), "identity", "left")
    pages = pages.join(v["v_text"], "identity", "left") if text else pages.withColumn("text", F.lit(""))

    def maybe(name: str):
        return F.array_compact(F.array(name)).cast("array<string>")

    heading = F.when(F.col("k") % 4 == 0, F.col("title")).otherwise(F.concat(F.lit("Part "), F.col("k").cast("string")))
    hop = lambda a, b: F.struct(a.alias("from"), b.alias("to"), F.col("status").alias("status"))
    start, middle = F.concat("identity", F.lit("/old")), F.concat("identity", F.lit("/mid"))
    last = F.when(F.col("hops_loop"), start).otherwise(F.col("identity"))
    hops = F.when(F.col("n_hops") == 1, F.array(hop(start, last))).when(F.col("n_hops") == 2, F.array(hop(start, middle), hop(middle, last))).otherwise(F.array()).cast(f"array<{schemas.HOP}>")
    flags = F.struct("truncated", F.col("challenged").alias("challenge"), (F.col("status") >= 400).alias("error_status"), "non_html", F.col("fallback").alias("encoding_fallback"))
    headings = F.transform(F.slice(F.array(F.lit(1), F.lit(2)), 1, F.col("n_h1")), lambda i: F.struct(F.lit(1).alias("level"), F.when(i == 1, heading).otherwise(F.lit("More")).alias("text")))
    page = F.struct(
        flags.alias("flags"), F.col("status").cast("int").alias("status"), "content_type", F.lit(None).cast("long").alias("duration_ms"), F.col("raw_bytes").cast("long").alias("raw_bytes"), F.col("raw_bytes").cast("long").alias("decoded_bytes"),
        F.lit("utf-8").alias("encoding"), "charset_declared", "doctype", "html_lang", maybe("title").alias("titles"), maybe("description").alias("descriptions"), headings.alias("headings"),
        maybe("robots_meta").alias("robots_meta"), maybe("robots_header").alias("robots_headers"), F.coalesce("v_canonicals", F.array().cast("array<string>")).alias("canonicals"),
        F.coalesce("v_hreflangs", F.array().cast("array<struct<lang:string,href:string>>")).alias("hreflangs"), "viewport", "has_frames", F.col("has_plugin").alias("has_plugin_markup"),
        maybe("refresh").alias("meta_refresh"), F.coalesce("v_structured", F.array().cast("array<struct<format:string,index:int,raw:string,types:array<string>>>")).alias("structured"), F.coalesce("text", F.lit("")).alias("text"),
    )
    observations = pages.select("identity", page.alias("page"), F.array().cast(f"array<{schemas.LINK}>").alias("links"), F.array().cast(f"array<{schemas.RESOURCE}>").alias("resources"), hops.alias("redirect_chain"))
    probe = [("http_homepage", "http://shop.example/", "http://shop.example/", 200, [], [], None), ("https_www", "https://www.shop.example/", "https://www.shop.example/", 200, [], [], None), ("https_apex", "https://shop.example/", "https://shop.example/", 200, [], [], None)]
    robots = [("https://shop.example", "bot/1.0", "bot", "*", "fetched", 200, [], ["Line 3: unknown field 'noidex'"], [])]
    return Evidence(
        spark, materialised(observations)[0], link_rows=lambda: materialised(links)[0], resource_rows=lambda: materialised(resources)[0],
        urls=v["v_urls"].select("original", "identity", "state", "reason", F.col("click_depth").cast("int").alias("click_depth"), F.lit(True).alias("via_website"), F.lit(False).alias("via_sitemap")),
        sitemap_files=v["v_sitemap_files"].select("url", F.col("url").alias("identity"), "state", "reason", F.col("listed_urls").cast("long").alias("listed_urls")),
        sitemap_urls=v["v_sitemap_urls"].select("original", "identity", null.alias("skip_reason"), "source_sitemap"),
        sitemap_known=True, sitemap_done=True,
        robots=spark.createDataFrame(robots, schemas.ROBOTS_RUN),
        resource_fetches=v["v_fetches"].select("identity", F.col("status").cast("int").alias("status"), "failed_reason", "challenge", F.lit(False).alias("credentials_attached"), "robots_blocked", F.lit(True).alias("robots_known"), F.lit("").alias("content_type")),
        tls_inspections=v["v_tls"].select("host", "port", "inspected", F.col("hostname_ok").alias("verified"), "hostname_ok", F.lit(0).cast("long").alias("not_before_unix"), F.col("not_after").cast("long").alias("not_after_unix"), F.array("name").alias("names"), null.alias("error")),
        host_probes=spark.createDataFrame(probe, schemas.HOST_PROBE), start_url=START, now=NOW,
    )


def branches(spark: SparkSession, folder: str) -> Evidence:
    """A second run, over the sites of the branches: an insecure start address and origins of which some have no robots.txt."""
    found = views(spark, folder, "v_branch_robots")["v_branch_robots"]
    none = F.array().cast("array<string>")
    robots = found.select("origin", F.lit("bot/1.0").alias("user_agent"), F.lit("bot").alias("product_token"), F.lit("*").alias("selected_group"), "fetch_kind", F.col("fetch_status").cast("int").alias("fetch_status"), none.alias("sitemaps"), none.alias("format_errors"), none.alias("crawl_delay_notes"))
    return Evidence(spark, spark.createDataFrame([], schemas.OBSERVATION), robots=robots, start_url="http://branch.example/", now=NOW)
