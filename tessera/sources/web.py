"""Pages, feeds, sitemaps and listings as DataFrames; which addresses and hosts may be fetched.

HTML is read with the standard library's parser in pandas UDFs. A page's text is its JSON-LD article
body, else the first of SELECTORS with 300 characters or more, else, where other software would guess
the main content, the whole body. Page metadata stays in a column of its own and can't override
the operator's settings.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import logging
import os
import re
import socket
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin, urlparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import normalize_ws, parse_datetime, stable_hash, text_hash, unwrap_archive_fragment
from tessera.plans.config import Source

LOG = logging.getLogger(__name__)

#: Where article text is looked for, in this order, and the types of JSON-LD articles.
SELECTORS = (".article-body", "#content-body", ".mrf-article-body", "article", "main")
ARTICLE_TYPES = ("NewsArticle", "Article", "BlogPosting")
LEAST_CHARS = 300
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def squeeze(text: str | None) -> str:
    """Entities resolved, white space normalised."""
    return re.sub(r"\s+", " ", unescape(text or "")).strip()


def _matches(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    if selector[0] == ".":
        return selector[1:] in (attrs.get("class") or "").split()
    return attrs.get("id") == selector[1:] if selector[0] == "#" else tag == selector


class _Page(HTMLParser):
    """One pass over a page: texts of the selected elements, title, meta tags, scripts and links."""

    def __init__(self, selectors: tuple[str, ...] = SELECTORS):
        super().__init__(convert_charrefs=True)
        self.selectors, self.open = selectors, []
        self.texts: dict[str, list[str]] = {}
        self.active: dict[str, int] = {}
        self.meta: dict[str, str] = {}
        self.title: list[str] | None = None
        self.scripts: list[str] = []
        self.links: list[str] = []
        self.body: list[str] = []
        self.in_ld = False

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in reversed(attrs)}
        if tag == "a" and "href" in found:
            self.links.append(found["href"])
        if tag == "meta":
            key = found.get("property") or found.get("name")
            if key and found.get("content"):
                self.meta[key] = squeeze(found["content"])
        if tag == "script" and found.get("type") == "application/ld+json":
            self.in_ld = True
            self.scripts.append("")
        if tag == "title" and self.title is None:
            self.title = []
        if tag in _VOID:
            return
        self.open.append(tag)
        for s in self.selectors:
            if s not in self.texts and _matches(s, tag, found):
                self.texts[s], self.active[s] = [], len(self.open)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "script":
            self.in_ld = False
        if tag in self.open:
            while self.open:
                depth, last = len(self.open), self.open.pop()
                self.active = {s: d for s, d in self.active.items() if d != depth}
                if last == tag:
                    break

    def handle_data(self, data):
        if self.in_ld:
            self.scripts[-1] += data
        if self.open and self.open[-1] == "title" and self.title is not None:
            self.title.append(data)
        if any(t in _HIDDEN for t in self.open[-1:]):
            return
        for s in self.active:
            self.texts[s].append(data)
        if "head" not in self.open and "title" not in self.open:
            self.body.append(data)


def read_page(html: str | None, selectors: tuple[str, ...] = SELECTORS) -> _Page:
    """A parsed page; null is an empty one."""
    page = _Page(selectors)
    page.feed(html or "")
    page.close()
    return page


def json_ld(page: _Page) -> list[dict]:
    """All JSON-LD objects of a page; broken ones are skipped."""
    out = []
    for raw in page.scripts:
        try:
            data = json.loads(raw)
        except ValueError:
            continue
        out += [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]
    return out


def _articles(page: _Page) -> list[dict]:
    kinds = lambda o: o["@type"] if isinstance(o.get("@type"), list) else [o.get("@type")]
    return [o for o in json_ld(page) if any(k in ARTICLE_TYPES for k in kinds(o))]


def article_text(html: str | None) -> tuple[str, str, str | None]:
    """(text, where it was found, why the page is skipped)."""
    page = read_page(html)
    for o in _articles(page):
        if o.get("isAccessibleForFree") is False:
            return "", "", "json_ld_declares_not_free"
        if isinstance(o.get("articleBody"), str) and squeeze(o["articleBody"]):
            return squeeze(o["articleBody"]), "json-ld:articleBody", None
    for s in SELECTORS:
        text = squeeze(" ".join(page.texts.get(s, ())))
        if len(text) >= LEAST_CHARS:
            return text, s, None
    return squeeze(" ".join(page.body)), "body", None


@F.pandas_udf(_strings("text", "selector", "skip_reason"))
def article(html: pd.Series) -> pd.DataFrame:
    """article_text() of each page."""
    return pd.DataFrame([article_text(x) for x in html], columns=["text", "selector", "skip_reason"])


def _meta_of(html: str | None) -> dict[str, str]:
    page = read_page(html, ())
    return ({"title": squeeze(" ".join(page.title))} if page.title is not None else {}) | page.meta


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def meta(html: pd.Series) -> pd.Series:
    """Title and meta tags by property or name; the last wins."""
    return html.map(_meta_of)


def _head_of(html: str | None) -> tuple:
    o = next(iter(_articles(read_page(html, ()))), {})
    author = o.get("author")
    author = author[0] if isinstance(author, list) and author else author
    author = author.get("name") if isinstance(author, dict) else author
    text = lambda x: x if isinstance(x, str) and x else None
    return text(o.get("headline")), text(author), text(o.get("datePublished"))


@F.pandas_udf(_strings("headline", "author", "published"))
def article_head(html: pd.Series) -> pd.DataFrame:
    """Headline, author and date of the first JSON-LD article."""
    return pd.DataFrame([_head_of(x) for x in html], columns=["headline", "author", "published"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def listing_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """Addresses of all links of a listing, in order, each once."""
    return pd.Series([list(dict.fromkeys(urljoin(b or "", x) for x in read_page(h, ()).links)) for h, b in zip(html, base)])


@F.pandas_udf(T.StringType())
def plain_text(html: pd.Series) -> pd.Series:
    """Text of a fragment of HTML."""
    return html.map(lambda x: squeeze(" ".join(read_page(x, ()).body)))


def sitemap_urls(xml: Column | str) -> Column:
    """Addresses of a sitemap, in order, each once."""
    return F.array_distinct(F.filter(F.xpath(F.col(xml) if isinstance(xml, str) else xml, F.lit("//*[local-name()='loc']/text()")), lambda x: x != ""))


def _items(xml: str | None) -> list[tuple]:
    text = lambda e, *tags: next((squeeze(n.text) for t in tags if (n := e.find(t)) is not None and n.text and squeeze(n.text)), None)
    out = []
    try:
        root = ET.fromstring(xml or "<none/>")
    except ET.ParseError as e:
        LOG.warning("a feed can't be read: %s", e)
        return out
    for e in root.iterfind(".//item"):
        link = text(e, "link")
        if link:
            summary = squeeze(" ".join(read_page(text(e, "description"), ()).body))
            out.append((text(e, "title"), link, summary, text(e, "author", "{http://purl.org/dc/elements/1.1/}creator"), text(e, "pubDate"), text(e, "guid"), [squeeze(c.text) for c in e.findall("category") if squeeze(c.text)]))
    return out


_ITEM = ("title", "link", "summary", "author", "published", "guid", "categories")


@F.pandas_udf(T.ArrayType(T.StructType([*_strings(*_ITEM[:-1]).fields, T.StructField("categories", T.ArrayType(T.StringType()))])))
def feed_items(xml: pd.Series) -> pd.Series:
    """Items of an RSS feed that have a link, in order; a feed that can't be read has none."""
    return xml.map(lambda x: [dict(zip(_ITEM, i)) for i in _items(x)])


def _archive(html: str | None, base: str, title_include: str | None) -> list[dict]:
    out, seen = [], set()
    for piece in re.findall(r"<article\b.*?</article>", html or "", re.S | re.I):
        heading, link, time = re.search(r"<h2\b[^>]*>(.*?)</h2>", piece, re.S | re.I), re.search(r"<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)", piece, re.S | re.I), re.search(r"<time\b[^>]*?\bdate\s*=\s*[\"']([^\"']*)", piece, re.S | re.I)
        if not heading or not link:
            continue
        title, url = squeeze(" ".join(read_page(heading[1], ()).body)), urljoin(base, unescape(link[1]))
        if (title_include and title_include not in title) or url in seen:
            continue
        seen.add(url)
        out.append({"title": title, "url": url, "published": time[1] if time else ""})
    return out


def archive_items(fragment: Column, base: str, title_include: str | None = None) -> Column:
    """(title, url, published) of the articles in an archive's escaped fragment."""
    read = F.pandas_udf(lambda s: s.map(lambda x: _archive(x, base, title_include)), T.ArrayType(_strings("title", "url", "published")))
    return read(unwrap_archive_fragment(fragment))


def allowed_url(url: Column | str, include: str | list[str] | None) -> Column:
    """Whether an address holds the given piece, or any of several; None lets all pass."""
    u = F.col(url) if isinstance(url, str) else url
    if include is None:
        return F.lit(True)
    include = [include] if isinstance(include, str) else include
    return F.exists(F.array(*(F.lit(x) for x in include)).cast("array<string>"), lambda n: F.contains(u, n))


def discovered(found: DataFrame, order: str, source: Column, limit: int) -> DataFrame:
    """First row of each url by `order`, ranked within its source, at most `limit` each. Failures later on aren't filled up."""
    first = found.withColumn("__n", F.row_number().over(W.partitionBy("url").orderBy(order))).where("__n = 1").drop("__n").withColumn("source", source)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(order))).where(F.col("rank") <= limit)


def cache_path(url: Column | str) -> Column:
    """Where a fetched page is kept: host and port, then hash."""
    u = F.col(url) if isinstance(url, str) else url
    return F.concat(F.replace(F.parse_url(u, F.lit("AUTHORITY")), F.lit(":"), F.lit("_")), F.lit("/"), F.substring(F.sha2(u, 256), 1, 32), F.lit(".html"))


def is_safe_url(url: Column | str) -> Column:
    """Rules that an address's text decides: http or https, no control characters or credentials, a host that isn't local.
    A dotted IPv4 host passes if it is public; other numeric hosts are refused here, and decided exactly by safe_url()."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(u, "^[A-Za-z]+://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/:?#]*)", 1))
    part = lambda k: F.try_element_at(F.split(host, "\\."), F.lit(k)).try_cast("int")
    a, b, c = part(1), part(2), part(3)
    dotted = host.rlike("^(?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)$")
    local = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    local = local | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    public = dotted & ~local
    return F.coalesce(
        F.lower(u).rlike("^https?://") & ~u.rlike("[\\x00-\\x20\\x7f]") & ~F.lower(u).rlike("^https?://[^/?#]*@") & (host != "") & ~host.rlike("^(localhost|.*\\.localhost)$") & (public | ~host.rlike("^(\\d+|0x[0-9a-f]+|[0-9.]+|\\[.*)$")), F.lit(False)
    )


class UnsafeURL(ValueError):
    """The address may not be fetched."""


def _address(host: str):
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        try:
            return ipaddress.ip_address(socket.inet_aton(host))
        except OSError:
            return None


def safe_url(url: str) -> str:
    """The address if it may be fetched; raises UnsafeURL otherwise."""
    if not isinstance(url, str) or not url.strip() or "\r" in url or "\n" in url:
        raise UnsafeURL("empty, or with control characters")
    try:
        parts = urlparse(url)
        parts.port  # noqa: B018  raises for a bad port
    except ValueError as e:
        raise UnsafeURL(str(e)) from e
    host = (parts.hostname or "").rstrip(".").lower()
    if parts.scheme.lower() not in ("http", "https") or not host or "%" in host or "\\" in host or any(c.isspace() for c in host):
        raise UnsafeURL("no http address with a valid host")
    if parts.username is not None or parts.password is not None:
        raise UnsafeURL("with credentials")
    address = _address(host)
    if host == "localhost" or host.endswith(".localhost") or (address is not None and not address.is_global):
        raise UnsafeURL("a local host")
    return url


def safe_redirect(source: str, target: str) -> str:
    """The target if it may be followed: safe, and no step from https down to http."""
    target = safe_url(urljoin(source, target))
    if urlparse(source).scheme.lower() == "https" and urlparse(target).scheme.lower() != "https":
        raise UnsafeURL("leaves https")
    return target


def safe_addresses(addresses: list[str]) -> list[str]:
    """What a name resolved to, each once, if every address is public; raises UnsafeURL otherwise."""
    out = []
    for a in addresses:
        try:
            found = ipaddress.ip_address(a.split("%", 1)[0])
        except ValueError as e:
            raise UnsafeURL("no address") from e
        if not found.is_global:
            raise UnsafeURL("resolves to a local address")
        if str(found) not in out:
            out.append(str(found))
    if not out:
        raise UnsafeURL("resolves to nothing")
    return out


#: What marks an agent that nobody has filled in.
PLACEHOLDERS = ("example.com", "example.org", "configure", "change-me", "<", ">")


def valid_user_agent(agent: str) -> bool:
    """At least 12 characters, with a contact address, without placeholders."""
    text = " ".join(agent.split())
    return len(text) >= 12 and bool(re.search(r"https?://[^\s)]+", text, re.I)) and not any(x in text.lower() for x in PLACEHOLDERS)


def robots_rules(status: int | None, text: str = "", allow_unavailable: bool = False, refused: bool = False) -> RobotFileParser:
    """Rules from the outcome of fetching robots.txt. status None: network error; refused: too large or unsafe.

    401, 403 and refused deny all; other errors and files without a User-agent line count as
    unavailable, which denies all too unless the operator allows it.
    """
    rules = RobotFileParser()
    usable = status is not None and status < 400 and any(re.match(r"\s*user-agent\s*:", x, re.I) for x in text.splitlines() if not x.lstrip().startswith("#"))
    if refused or status in (401, 403) or (not usable and not allow_unavailable):
        rules.parse(["User-agent: *", "Disallow: /"])
    elif not usable:
        rules.parse(["User-agent: *", "Allow: /"])
    else:
        rules.parse(text.splitlines())
    return rules


#: Answers that send on.
REDIRECTS = (301, 302, 303, 307, 308)


class Response(NamedTuple):
    """What a transport brings: status, body, where it sends on, and the declared character set."""

    status: int
    body: bytes = b""
    location: str | None = None
    charset: str | None = None


class Fetcher:
    """Fetching decisions over a transport get(url, address, agent, limit) -> Response, with resolve(host, port) -> addresses.

    A name is resolved once for each request; the request goes to the addresses that were checked, the
    next one if a connection fails. get() raises OSError for a failed connection and OverflowError for more
    than limit bytes. Requests keep a delay. With a cache_dir, fetched pages are kept under their own address.
    """

    def __init__(
        self, get: Callable, resolve: Callable, agent: str, allow_robots_unavailable: bool = False, max_bytes: int = 10 << 20, max_robots_bytes: int = 512 << 10, max_redirects: int = 5,
        delay: float = 0.0, cache_dir: str | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
    ):
        if not valid_user_agent(agent):
            raise ValueError("a user agent with a contact address is needed")
        self.get, self.resolve, self.agent, self.allow = get, resolve, agent, allow_robots_unavailable
        self.max_bytes, self.max_robots_bytes, self.max_redirects, self.robots = max_bytes, max_robots_bytes, max_redirects, {}
        self.delay, self.cache_dir, self.clock, self.sleep, self.last = delay, cache_dir, clock, sleep, None

    def _send(self, url: str, limit: int) -> Response:
        """One request, to the first checked address that answers."""
        parts = urlparse(safe_url(url))
        try:
            found = list(self.resolve(parts.hostname, parts.port or (443 if parts.scheme.lower() == "https" else 80)))
        except OSError as e:
            raise UnsafeURL(f"{parts.hostname} can't be resolved") from e
        addresses = safe_addresses(found)
        if self.last is not None and (wait := self.last + self.delay - self.clock()) > 0:
            self.sleep(wait)
        self.last, failed = self.clock(), None
        for address in addresses:
            try:
                answer = Response(*self.get(url, address, self.agent, limit))
                if len(answer.body) > limit:
                    raise OverflowError("the response is too large")
                return answer
            except OSError as e:
                failed = e
        raise failed

    def _follow(self, url: str, limit: int, check: bool) -> tuple[int, str]:
        for _ in range(self.max_redirects + 1):
            if check and not self.can_fetch(url):
                raise PermissionError(f"robots.txt denies {url}")
            answer = self._send(url, limit)
            if answer.status not in REDIRECTS or not answer.location:
                return answer.status, decoded(answer.body, answer.charset)
            url = safe_redirect(url, answer.location)
        raise UnsafeURL("too many redirects")

    def can_fetch(self, url: str) -> bool:
        """Whether the host's robots.txt, read once, lets the address be fetched."""
        parts = urlparse(safe_url(url))
        root = f"{parts.scheme}://{parts.netloc}"
        if root not in self.robots:
            try:
                status, text = self._follow(f"{root}/robots.txt", self.max_robots_bytes, False)
                self.robots[root] = robots_rules(status, text, self.allow)
            except (UnsafeURL, OverflowError):
                self.robots[root] = robots_rules(None, refused=True)
            except OSError:
                self.robots[root] = robots_rules(None, allow_unavailable=self.allow)
        return self.robots[root].can_fetch(self.agent, url)

    def kept_path(self, url: str) -> str | None:
        """Where the page of an address is kept, as cache_path() says."""
        host = urlparse(safe_url(url)).netloc.replace(":", "_")
        return self.cache_dir and os.path.join(self.cache_dir, host, hashlib.sha256(url.encode()).hexdigest()[:32] + ".html")

    def fetch(self, url: str, use_cache: bool = True) -> tuple[str, str | None, bool]:
        """(text of a page, where it is kept, whether it was there before)."""
        path = self.kept_path(url)
        if use_cache and path and os.path.exists(path):
            if os.path.getsize(path) > self.max_bytes:
                raise OverflowError("the stored response is too large")
            with open(path, encoding="utf-8", errors="replace") as f:
                return f.read(), path, True
        status, text = self._follow(url, self.max_bytes, True)
        if status >= 400:
            raise OSError(f"status {status}")
        if len(body := text.encode()) > self.max_bytes:
            raise OverflowError("the response is too large")
        if path:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(body)
        return text, path, False


def decoded(body: bytes, charset: str | None) -> str:
    """Text of a body; an unknown character set counts as UTF-8, what doesn't decode is replaced."""
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _documents(rows: DataFrame, source: Source, rank: str) -> DataFrame:
    """The document schema for rows of url, title, author, published, text, page (meta tags), rank, fetched_at, path."""
    keys = F.create_map(F.lit(rank), F.col("rank").cast("string"), F.lit("source_attention_weight"), F.lit(str(source.attention_weight)), F.lit("source_attention_note"), F.lit(source.attention_note or ""))
    return rows.select(
        F.concat(F.lit("doc_"), stable_hash(F.lit(source.name), "url", length=24)).alias("id"), F.lit(source.name).alias("source_name"), F.lit(source.kind).alias("source_kind"), F.lit(source.side).alias("source_side"),
        "url", normalize_ws("title").alias("title"), normalize_ws("text").alias("text"), "author", parse_datetime("published").alias("published_at"), "fetched_at", F.col("path").alias("raw_html_path"), keys.alias("metadata"), "page", text_hash("text").alias("text_hash"),
    ).where("text <> '' and title <> ''")


def _filled(*names: Column | str) -> Column:
    return F.coalesce(*(F.nullif(F.col(n) if isinstance(n, str) else n, F.lit("")) for n in names))


def _read_pages(ranked: DataFrame, pages: DataFrame, least: int) -> DataFrame:
    """Discovered rows with what their landed pages hold. pages: url, html, fetched_at, path."""
    rows = ranked.join(pages, "url").withColumns({"a": article("html"), "page": meta("html"), "ld": article_head("html")})
    return rows.where(F.col("a.skip_reason").isNull()).withColumn("text", F.col("a.text")).where(F.length("text") >= least)


def collect_columns(found: DataFrame, pages: DataFrame, source: Source) -> DataFrame:
    """Documents of a sitemap's or listing's articles. found: url, pos in discovery order."""
    ranked = discovered(found.where(allowed_url("url", source.url_include)), "pos", F.lit(source.name), source.limit)
    rows = _read_pages(ranked, pages, LEAST_CHARS)
    p = lambda k: F.try_element_at("page", F.lit(k))
    rows = rows.withColumns({"title": _filled("ld.headline", p("og:title"), p("twitter:title"), p("title"), "url"), "author": _filled("ld.author", p("author"), p("article:author")), "published": _filled("ld.published", p("article:published_time"), p("fecha_publicacion"))})
    return _documents(rows, source, "listing_rank")


def collect_archive(items: DataFrame, pages: DataFrame, source: Source) -> DataFrame:
    """Documents of an archive's items (title, url, published, pos)."""
    ranked = discovered(items.withColumnsRenamed({"title": "item_title", "published": "item_published"}), "pos", F.lit(source.name), source.limit)
    p = lambda k: F.try_element_at("page", F.lit(k))
    rows = _read_pages(ranked, pages, LEAST_CHARS)
    own = parse_datetime("item_published").isNotNull()
    rows = rows.withColumns({"title": _filled("item_title", p("og:title"), p("title"), "url"), "author": p("author"), "published": F.when(own, F.col("item_published")).otherwise(_filled(p("article:published_time"), p("fecha_publicacion")))})
    return _documents(rows, source, "archive_rank")


def collect_feed(items: DataFrame, source: Source, pages: DataFrame | None = None) -> DataFrame:
    """Documents of a feed's items (feed_items() exploded, with pos, fetched_at, path): their summaries, or the articles behind their links."""
    ranked = items.withColumn("rank", F.row_number().over(W.orderBy("pos"))).where(F.col("rank") <= source.limit).withColumn("url", F.col("link"))
    if not source.fetch_article:
        rows = ranked.withColumn("title", _filled("title", "url")).withColumn("text", normalize_ws(F.concat(F.col("title"), F.lit(". "), F.coalesce("summary", F.lit("")))))
        return _documents(rows.withColumn("page", F.create_map().cast("map<string,string>")).where(F.length("text") >= source.min_text_chars), source, "feed_rank")
    p = lambda k: F.try_element_at("page", F.lit(k))
    rows = _read_pages(ranked.drop("fetched_at", "path").withColumnsRenamed({"title": "item_title", "author": "item_author", "published": "item_published"}), pages, source.min_text_chars)
    own = parse_datetime("item_published").isNotNull()
    rows = rows.withColumns({"title": _filled(p("og:title"), p("twitter:title"), p("title"), "item_title", "url"), "author": _filled("item_author", p("author"), p("article:author")), "published": F.when(own, F.col("item_published")).otherwise(_filled(p("article:published_time"), p("fecha_publicacion")))})
    return _documents(rows, source, "feed_rank")
