"""Extraction of observations from HTTP responses: one pass over the markup of a page.

extract() reads one response in Python; observations() applies it to a DataFrame of responses in Arrow batches, the
slow but complete way. title_of(), h1_of() and link_hrefs() read plain markup with patterns in the JVM.

Behaviour that the rules rely on: the first <base> and <html lang> win; comments, scripts, styles and noscript are
skipped; text inside nav, header, footer and aside is left out while links there are kept; an anchor and a heading
consume their inner markup, so images in anchors aren't resources; a closing tag is found by its name's beginning;
the title isn't part of the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden import schemas
from sitewarden.functions.urls import owner as owner_of
from sitewarden.functions.urls import parse as parse_url

SCHEMA_VERSION = 4
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype([^>]*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Elements whose text is not the page's main text, and elements whose content is skipped.
CHROME, SKIPPED = ("nav", "header", "footer", "aside"), ("script", "style", "noscript")
#: Named character references that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}


def decode_entities(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return NAMED.get(m[1], m[0])
        code = int(m[2][1:], 16) if m[2][0] in "xX" else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&(?:([a-z]+)|#(\d+|[xX][0-9a-fA-F]+));", one, text)


def collapse(text: str) -> str:
    return " ".join(text.split())


def inner_text(markup: str) -> str:
    return collapse(decode_entities(re.sub(r"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", " ", markup)))


def attributes(source: str) -> dict[str, str]:
    """Lower-case names to decoded values; the first of a name wins; a name without a value has an empty one."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), decode_entities(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def decode_body(content_type: str, body: bytes) -> tuple[str, str, bool, bool]:
    """(text, encoding, whether it fell back to another encoding, whether a charset was declared)."""
    declared = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    sniffed = re.search(rb"charset\s*=\s*[\"']?([\w.:-]+)", body[:1024], re.I)
    name = (declared[1] if declared else sniffed[1].decode() if sniffed else "").lower()
    if body.startswith(b"\xef\xbb\xbf"):
        return body[3:].decode("utf-8", "replace"), "utf-8", False, bool(name)
    if name in ("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252"):
        return _cp1252(body), "windows-1252", False, True
    try:
        return body.decode("utf-8"), "utf-8", False, bool(name)
    except UnicodeDecodeError:
        return _cp1252(body), "windows-1252", True, bool(name)


def _cp1252(body: bytes) -> str:
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in body) if any(b in body for b in b"\x81\x8d\x8f\x90\x9d") else body.decode("cp1252")


def is_html(content_type: str, text: str) -> bool:
    media = (content_type or "").split(";")[0].strip().lower()
    if media:
        return media in ("text/html", "application/xhtml+xml")
    return bool(re.search(r"<html|<!doctype", text, re.I))


def parse_link_header(value: str) -> tuple[list[str], list[dict]]:
    """Canonicals and alternates of a Link header; commas inside quotes and angle brackets don't split."""
    canonicals, alternates = [], []
    for part in re.findall(r"(?:<[^>]*>|\"[^\"]*\"|[^,])+", value):
        m = re.match(r"\s*<([^>]*)>(.*)", part, re.S)
        if not m:
            continue
        params = {k.lower(): v.strip().strip('"') for k, _, v in (p.strip().partition("=") for p in m[2].split(";") if p.strip())}
        rel = params.get("rel", "").lower().split()
        if "canonical" in rel:
            canonicals.append(m[1].strip())
        if "alternate" in rel and "hreflang" in params:
            alternates.append({"lang": params["hreflang"], "href": m[1].strip()})
    return canonicals, alternates


def extract(url: str, status: int | None, content_type: str | None, headers: list[tuple[str, str]] | None, body: bytes | None, truncated: bool = False, duration_ms: int | None = None, redirects: list[dict] | None = None) -> dict:
    """The observation of one response, as the nested record of schemas.OBSERVATION.

    A response without a status is one that failed, so it counts as an error; missing headers or body are empty ones."""
    headers, body = headers or [], body or b""
    document = parse_url(url)
    text, encoding, fallback, declared = decode_body(content_type, body)
    low = text.lower()
    page = {
        "flags": {"truncated": truncated, "challenge": "cf-chl-" in low or "<title>just a moment" in low, "error_status": status is None or status >= 400, "non_html": not is_html(content_type, text), "encoding_fallback": fallback},
        "status": status, "content_type": content_type, "duration_ms": duration_ms, "raw_bytes": len(body), "decoded_bytes": len(text.encode()),
        "encoding": encoding, "charset_declared": declared, "doctype": None, "html_lang": None, "titles": [], "descriptions": [], "headings": [],
        "robots_meta": [], "robots_headers": [v for k, v in headers if k.lower() == "x-robots-tag"], "canonicals": [], "hreflangs": [], "viewport": None,
        "has_frames": False, "has_plugin_markup": False, "meta_refresh": [], "structured": [], "text": "",
    }
    for name, value in headers:
        if name.lower() == "link":
            canonicals, alternates = parse_link_header(value)
            page["canonicals"] += canonicals
            page["hreflangs"] += alternates
    own = document.text() if document else url
    links, resources = _scan(text, document, own, page) if not page["flags"]["non_html"] else ([], [])
    return {"identity": own, "page": page, "links": links, "resources": resources, "redirect_chain": redirects or []}


def _scan(text: str, document, own: str, page: dict) -> tuple[list[dict], list[dict]]:
    links: list[dict] = []
    resources: list[dict] = []
    chunks: list[str] = []
    base, chrome, at = None, 0, 0
    counts = {"json_ld": 0, "microdata": 0, "rdfa": 0}

    def target(href: str):
        return parse_url(href, base or document) if href.strip() else None

    def resource(kind: str, href: str, alt: str | None) -> None:
        found = target(href)
        resources.append({"referring": own, "kind": kind, "href": href, "destination": found.text() if found else None, "alt": alt, "host_owner": owner_of(document, found)})

    def structured(kind: str, raw: str, types: list[str]) -> None:
        page["structured"].append({"format": kind, "index": counts[kind], "raw": raw, "types": types})
        counts[kind] += 1

    def closing(name: str, start: int) -> tuple[str, int]:
        """What is inside up to the next closing tag whose name begins so, and where that tag ends."""
        m = re.compile(rf"</{name}[^>]*>?", re.I).search(text, start)
        return (text[start : m.start()], m.end()) if m else (text[start:], len(text))

    while m := _TAG.search(text, at):
        if not chrome:
            chunks.append(text[at : m.start()])
        at = m.end()
        if m[1] is not None:
            page["doctype"] = page["doctype"] if page["doctype"] is not None else m[1].strip()
            continue
        if not m[3]:
            continue
        name, end = m[3].lower(), bool(m[2])
        if name in CHROME:
            chrome = max(0, chrome + (-1 if end else 1))
            continue
        if end:
            continue
        attr = attributes(m[4])
        if "itemscope" in attr:
            structured("microdata", m[0], attr.get("itemtype", "").split())
        if attr.get("typeof"):
            structured("rdfa", m[0], attr["typeof"].split())
        if name in SKIPPED:
            inside, at = closing(name, at)
            if name == "script":
                if attr.get("type", "").strip().lower() == "application/ld+json":
                    structured("json_ld", inside.strip(), [])
                elif "src" in attr:
                    resource("script", attr["src"], None)
        elif name == "base" and base is None and attr.get("href"):
            base = parse_url(attr["href"], document)
        elif name == "html" and page["html_lang"] is None and "lang" in attr:
            page["html_lang"] = attr["lang"]
        elif name == "title":
            inside, at = closing(name, at)
            page["titles"].append(inner_text(inside))
        elif re.fullmatch("h[1-6]", name):
            inside, at = closing(name, at)
            heading = inner_text(inside)
            page["headings"].append({"level": int(name[1]), "text": heading})
            if not chrome:
                chunks.append(heading)
        elif name == "meta":
            _meta(attr, page)
        elif name == "link":
            rel, href = attr.get("rel", "").lower().split(), attr.get("href", "")
            if "canonical" in rel:
                page["canonicals"].append(href)
            if "alternate" in rel and "hreflang" in attr:
                page["hreflangs"].append({"lang": attr["hreflang"], "href": href})
            if "stylesheet" in rel and href:
                resource("style", href, None)
        elif name == "a" and "href" in attr or name == "area" and "href" in attr:
            anchor = attr.get("alt", "")
            if name == "a":
                inside, at = closing(name, at)
                anchor = inner_text(inside) or collapse(" ".join(attributes(i).get("alt", "") for i in re.findall(r"<img\b([^>]*)>", inside, re.I)))
                if not chrome:
                    chunks.append(re.sub(r"<[^>]*>", " ", inside))
            found = target(attr["href"])
            links.append({"source": own, "href": attr["href"], "destination": found.text() if found else None, "anchor": anchor, "rel": attr.get("rel", ""), "element": name, "host_owner": owner_of(document, found)})
        elif name == "img" and "src" in attr:
            resource("image", attr["src"], attr.get("alt"))
        elif name in ("frameset", "frame"):
            page["has_frames"] = True
        elif name in ("embed", "object", "applet"):
            page["has_plugin_markup"] = True
    if not chrome:
        chunks.append(text[at:])
    page["text"] = collapse(decode_entities(" ".join(chunks)))
    return links, resources


def _meta(attr: dict[str, str], page: dict) -> None:
    if "charset" in attr:
        page["charset_declared"] = True
    content = attr.get("content", "")
    name = (attr.get("name") or attr.get("http-equiv") or "").strip().lower()
    if name == "description":
        page["descriptions"].append(collapse(content))
    elif name in ("robots", "googlebot"):
        page["robots_meta"].append(content)
    elif name == "viewport":
        page["viewport"] = content if page["viewport"] is None else page["viewport"]
    elif name == "refresh":
        page["meta_refresh"].append(content)
    elif name == "content-type" and "charset=" in content.lower():
        page["charset_declared"] = True


def observations(responses: DataFrame) -> DataFrame:
    """Observations of responses (url, status, content_type, headers array<struct<name,value>>, body, truncated, duration_ms)."""
    schema = responses.sparkSession.createDataFrame([], schemas.OBSERVATION).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                found = [extract(r["url"], r["status"], r["content_type"], [(h["name"], h["value"]) for h in r["headers"] or []], bytes(r["body"] or b""), bool(r["truncated"]), r["duration_ms"]) for r in rows]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return responses.mapInArrow(run, schema)


def title_of(markup: Column) -> Column:
    """The first title of plain markup, without decoding."""
    return F.nullif(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title", 1), F.lit(""))


def h1_of(markup: Column) -> Column:
    return F.nullif(F.regexp_extract(markup, r"(?is)<h1[^>]*>(.*?)</h1", 1), F.lit(""))


def link_hrefs(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))




def navigation_links(text: str, url: str) -> list[tuple[str, str | None]]:
    """(href, address) of the anchors of a page, for a crawl: comments, scripts and styles are skipped, headings and
    other elements are not consumed."""
    document, base, found = parse_url(url), None, []
    body = re.sub(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1[^>]*>|\Z)", " ", text, flags=re.S | re.I)
    for m in re.finditer(r"<(a|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", body, re.I):
        href = attributes(m[2]).get("href")
        if href is None:
            continue
        if m[1].lower() == "base":
            base = base or parse_url(href, document)
        else:
            target = parse_url(href, base or document) if href.strip() else None
            found.append((href, target.text() if target else None))
    return found
