"""URLs: a subset of the WHATWG standard in Python, and Columns that reach for it only where a pattern can't tell.

Covered: special schemes (http, https, ws, wss, ftp), lower-casing of scheme and host, default ports, dot segments,
backslashes, percent-encoding of blanks and non-ASCII characters, IDNA hosts, relative references. Other schemes are
kept as they are and have no host."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote, urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Default ports of special schemes.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
#: A URL that is its own identity but for a fragment.
CANONICAL = r"^https?://[a-z0-9]([a-z0-9.-]*[a-z0-9])?(/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)*/?(\?[A-Za-z0-9._~=&+-]*)?(#[A-Za-z0-9._~-]*)?$"
#: A URL of another scheme that is its own identity but for a fragment.
OPAQUE = r"^(?!(https?|wss?|ftp):)[a-z][a-z0-9+.-]*:[!-~]*$"
_SAFE_PATH = "/:@!$&'()*+,;=-._~%[]|^\\"
_SAFE_QUERY = _SAFE_PATH + "?`{}"


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    @property
    def effective_port(self) -> int | None:
        return self.port if self.port is not None else PORTS.get(self.scheme)

    @property
    def origin(self) -> tuple:
        return self.scheme, self.host, self.effective_port

    def text(self, fragment: bool = True) -> str:
        out = f"{self.scheme}:"
        if self.host is not None:
            out += f"//{self.host}" + (f":{self.port}" if self.port is not None else "")
        out += self.path + (f"?{self.query}" if self.query is not None else "")
        return out + (f"#{self.fragment}" if fragment and self.fragment is not None else "")


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """A URL, relative to base if it is a reference; None if it can't be parsed."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    text, _, fragment = text.partition("#")
    fragment = quote(fragment, safe=_SAFE_QUERY) if _ else None
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
    if m:
        scheme, rest = m[1].lower(), text[m.end() :]
        if scheme not in PORTS:
            rest, q, query = rest.partition("?")
            return Url(scheme, None, None, rest, query if q else None, fragment)
        if not (base and base.scheme == scheme and not re.match(r"[/\\]", rest)):
            return _absolute(scheme, re.sub(r"^[/\\]*", "", rest), fragment)
        text = rest
    if base is None or base.host is None:
        return None
    if re.match(r"[/\\]{2}", text):
        return _absolute(base.scheme, text[2:], fragment)
    path, q, query = text.partition("?")
    query = quote(query, safe=_SAFE_QUERY) if q else None
    path = path.replace("\\", "/")
    if not path:
        return Url(base.scheme, base.host, base.port, base.path, query if q else base.query, fragment)
    if not path.startswith("/"):
        path = base.path.rsplit("/", 1)[0] + "/" + path
    return Url(base.scheme, base.host, base.port, _path(path), query, fragment)


def _absolute(scheme: str, rest: str, fragment: str | None) -> Url | None:
    authority = re.match(r"[^/\\?]*", rest)[0]
    tail, q, query = rest[len(authority) :].partition("?")
    hostport = authority.rpartition("@")[2]
    m = re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::([0-9]*))?", hostport)
    if not m or not m[1] or re.search(r"[\s<>\\^`{|}%]", m[1]):
        return None
    host = m[1].lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    port = int(m[2]) if m[2] else None
    if port is not None and port > 65535:
        return None
    return Url(scheme, host, None if port == PORTS[scheme] else port, _path(tail.replace("\\", "/")), quote(query, safe=_SAFE_QUERY) if q else None, fragment)


def _path(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:] if path.startswith("/") else path.split("/")
    for i, part in enumerate(parts):
        plain, last = part.lower().replace("%2e", "."), i == len(parts) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(quote(part, safe=_SAFE_PATH))
    return "/" + "/".join(out)


def identity(text: str | None) -> str | None:
    """The normal form without a fragment; what can't be parsed stays as it is."""
    url = parse(text)
    return url.text(fragment=False) if url else text


def resolve(base: str | None, href: str | None) -> str | None:
    """The identity that a reference on a page means; None if empty or not resolvable."""
    if not href or not href.strip():
        return None
    url = parse(href, parse(base))
    return url.text(fragment=False) if url else None


def owner(document: Url, destination: Url | None) -> str:
    if destination is None or destination.scheme not in ("http", "https"):
        return "opaque"
    same = destination.host == document.host and destination.effective_port == document.effective_port
    return "same_host" if same else "other_host"


def apex_and_www(host: str) -> tuple[str, str] | None:
    """The two names of a site; None for addresses and empty names."""
    if not host or re.fullmatch(r"[0-9.]+|\[.*\]", host):
        return None
    apex = host.removeprefix("www.")
    return (apex, f"www.{apex}") if apex else None


def names_include_host(names: list[str], host: str) -> bool:
    """Whether a certificate's names cover a host: equal, or `*.` for exactly one label."""
    host = host.lower().rstrip(".")
    for name in names or []:
        name = name.lower().rstrip(".")
        if name == host or name.startswith("*.") and host.partition(".")[2] == name[2:] and host.partition(".")[0]:
            return True
    return False


def without_parameters(text: str, names: list[str], case_sensitive: bool = True) -> str:
    """A URL without the listed query parameters, the others form-encoded again."""
    url = parse(text)
    if url is None or url.query is None:
        return text
    listed = set(names) if case_sensitive else {n.lower() for n in names}
    kept = [(k, v) for k, v in parse_qsl(url.query, keep_blank_values=True) if (k if case_sensitive else k.lower()) not in listed]
    return Url(url.scheme, url.host, url.port, url.path, urlencode(kept) or None, url.fragment).text()


def path_matches(path: str, pattern: str) -> bool:
    """A pattern with a final slash means that folder, any other is a plain prefix."""
    return path == pattern.rstrip("/") or path.startswith(pattern) if pattern.endswith("/") else path.startswith(pattern)


@F.pandas_udf(StringType())
def _identity_udf(urls: pd.Series) -> pd.Series:
    return urls.map(identity, na_action="ignore")


@F.pandas_udf(StringType())
def _resolve_udf(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else resolve(b, h) for b, h in zip(bases, hrefs)], dtype=object)


def is_plain(url: Column) -> Column:
    """Whether a URL is its own identity but for a fragment."""
    return url.rlike(CANONICAL) & ~url.rlike(r"^https?://[^/?#]*(\?|#|$)")


def identity_of(url: Column) -> Column:
    """identity() as a Column: plain URLs lose their fragment in the JVM, only the others go to Python."""
    plain = is_plain(url)
    return F.coalesce(F.when(plain, F.regexp_replace(url, "#.*$", "")), _identity_udf(F.when(~plain, url)), url)


def resolve_of(base: Column, href: Column) -> Column:
    """resolve() as a Column: absolute plain URLs stay in the JVM."""
    plain = is_plain(href)
    return F.coalesce(F.when(plain, F.regexp_replace(href, "#.*$", "")), _resolve_udf(F.when(~plain, base), F.when(~plain, href)))


def with_identity(rows: DataFrame, url: Column, name: str, look: bool = False) -> DataFrame:
    """rows with identity_of(url), those of plain and opaque URLs and of none apart from the others: a Python function in a
    plan gets every row, if only as a null, and all other columns wait for it in memory. rows is read twice, so it should
    be cheap to read. look: see at once whether there are odd ones; where there are none no Python worker starts."""
    plain = F.coalesce(is_plain(url) | url.rlike(OPAQUE), F.lit(True))
    if look and rows.where(~plain).isEmpty():
        return rows.withColumn(name, F.regexp_replace(url, "#.*$", ""))
    return rows.where(plain).withColumn(name, F.regexp_replace(url, "#.*$", "")).unionByName(rows.where(~plain).withColumn(name, identity_of(url)))


def with_resolved(rows: DataFrame, base: Column, href: Column, name: str) -> DataFrame:
    """rows with resolve_of(base, href), like with_identity."""
    plain = F.coalesce(is_plain(href), F.lit(False))
    return rows.where(plain).withColumn(name, F.regexp_replace(href, "#.*$", "")).unionByName(rows.where(~plain).withColumn(name, resolve_of(base, href)))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def query_pairs(url: Column) -> Column:
    """The number of query parameters."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.size(F.filter(F.split(query, "&"), lambda p: p != ""))


def exclusion(url: Column, origin: str, allowed: list[str], excluded: list[str], ignored: list[str], case_sensitive: bool = True) -> Column:
    """Why a profile leaves a URL out, null if it doesn't; the first reason in the order of the profile's checks."""
    path = path_of(url)

    def under(pattern: str) -> Column:
        if pattern.endswith("/"):
            return (path == pattern.rstrip("/")) | path.startswith(pattern)
        return path.startswith(pattern)

    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for test in tests:
            out = out | test
        return out

    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != ""), lambda p: F.split(p, "=")[0])
    if not case_sensitive:
        keys, ignored = F.transform(keys, F.lower), [i.lower() for i in ignored]
    outside = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1) != origin
    reason = F.when(outside, "Outside configured origin")
    if allowed:
        reason = reason.when(~any_of([under(p) for p in allowed]), "Not in allowed subfolders")
    folders, prefixes = [p for p in excluded if p.endswith("/")], [p for p in excluded if not p.endswith("/")]
    if folders:
        reason = reason.when(any_of([under(p) for p in folders]), "Excluded subfolder")
    if prefixes:
        reason = reason.when(any_of([under(p) for p in prefixes]), "Excluded path prefix")
    if ignored:
        reason = reason.when(F.arrays_overlap(keys, F.array(*map(F.lit, ignored))), "Ignored parameter")
    return reason


@F.pandas_udf(StringType())
def _strip_udf(urls: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else without_parameters(u, n.split("\n")) for u, n in zip(urls, names)], dtype=object)


def strip_parameters(url: Column, names: list[str]) -> Column:
    """The URL without the listed query parameters; URLs that name none of them stay in the JVM."""
    named = F.lit(False)
    for name in names:
        named = named | F.contains(url, F.lit(f"{name}="))
    return F.coalesce(F.when(~named, url), _strip_udf(F.when(named, url), F.lit("\n".join(names))), url)


def classify_href(base: Column, href: Column, left_out: Column, target: Column | None = None) -> Column:
    """What a crawl makes of a reference: (original, identity, skip_reason). left_out is the profile's reason for the
    resolved address, an exclusion() of it; target that address, if it is at hand."""
    target = resolve_of(base, href) if target is None else target
    reason = F.when(target.isNull(), "Malformed URL").when(~scheme_of(target).isin("http", "https"), "Unsupported scheme").otherwise(left_out)
    return F.struct(href.alias("original"), target.alias("identity"), reason.alias("skip_reason"))
