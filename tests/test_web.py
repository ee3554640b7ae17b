import pytest
from pyspark.sql import functions as F

from tessera.plans.config import AppConfig, Project, Source
from tessera.plans.pipeline import Engine
from tessera.sources import collect
from tessera.sources import web as Wb

LONG = "Texto del artículo con contenido suficiente. " * 12
PAGE = f"""<html><head><title> El título </title><meta property="og:title" content="OG &amp; más"><meta name="author" content="Ana"><meta property="article:published_time" content="2026-06-08T10:00:00Z">
<style>.x {{color: red}}</style></head><body><nav>menú</nav><article><h1>Hola</h1><script>var x = "oculto"</script><p>{LONG}</p></article><a href="/a">A</a><a href="b?x=1">B</a><a href="/a">otra vez</a></body></html>"""
LD = '<html><script type="application/ld+json">[{"@type": "Thing"}, {"@type": ["NewsArticle"], "headline": "Titular", "author": [{"name": "Eva"}], "datePublished": "2026-06-07", "articleBody": "Cuerpo  del texto"}]</script></html>'
CLOSED = '<script type="application/ld+json">{"@type": "Article", "isAccessibleForFree": false, "articleBody": "x"}</script>'
FEED = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><title>Uno</title><link> https://n.test/1 </link><dc:creator>Ana</dc:creator><pubDate>Mon, 08 Jun 2026 12:00:00 +0000</pubDate><description><![CDATA[<p>Resumen <b>largo</b></p>]]></description><category>x</category><category> </category></item>
<item><title>sin enlace</title></item><item><title>Dos</title><link>https://n.test/2</link></item></channel></rss>"""


def test_article_text():
    text, where, skipped = Wb.article_text(PAGE)
    assert where == "article" and skipped is None and text.startswith("Hola Texto") and "oculto" not in text and "menú" not in text
    assert Wb.article_text(LD) == ("Cuerpo del texto", "json-ld:articleBody", None)
    assert Wb.article_text(CLOSED)[2] == "json_ld_declares_not_free"
    assert Wb.article_text("<p>corto</p>") == ("corto", "body", None) and Wb.article_text(None) == ("", "body", None)
    assert Wb.article_text('<div class="a article-body">' + LONG + "</div>")[1] == ".article-body"
    assert Wb.article_text("<script type='application/ld+json'>{broken</script><p>x</p>")[0] == "x"


def test_page_udfs(spark):
    rows = spark.createDataFrame([(PAGE,), (LD,), (None,)], "html string").select(Wb.meta("html").alias("m"), Wb.article_head("html").alias("h"), Wb.listing_links("html", F.lit("https://n.test/list/")).alias("l")).collect()
    assert rows[0]["m"] == {"title": "El título", "og:title": "OG & más", "author": "Ana", "article:published_time": "2026-06-08T10:00:00Z"}
    assert rows[0]["l"] == ["https://n.test/a", "https://n.test/list/b?x=1"]
    assert tuple(rows[1]["h"]) == ("Titular", "Eva", "2026-06-07") and rows[2]["m"] == {}


def test_feed_documents(spark):
    items = spark.createDataFrame([(FEED,)], "xml string").select(F.posexplode(Wb.feed_items("xml")).alias("pos", "i")).select("pos", "i.*").withColumns({"fetched_at": F.current_timestamp(), "path": F.lit("f.xml")})
    assert [r["link"] for r in items.orderBy("pos").collect()] == ["https://n.test/1", "https://n.test/2"]
    source = Source("feed", "rss_feed", side="side", fetch_article=False, min_text_chars=5, attention_weight=0.3)
    docs = {r["url"]: r for r in Wb.collect_feed(items, source).collect()}
    r = docs["https://n.test/1"]
    assert r["text"] == "Uno. Resumen largo" and r["author"] == "Ana" and r["metadata"]["feed_rank"] == "1" and r["metadata"]["source_attention_weight"] == "0.3" and str(r["published_at"]) == "2026-06-08 12:00:00"
    pages = spark.createDataFrame([("https://n.test/1", PAGE), ("https://n.test/2", CLOSED)], "url string, html string").withColumns({"fetched_at": F.current_timestamp(), "path": F.lit("p")})
    full = Wb.collect_feed(items, Source("feed", "rss_feed"), pages).collect()
    assert [r["title"] for r in full] == ["OG & más"] and full[0]["page"]["author"] == "Ana"


def test_columns_and_archive(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://n.test/op/1</loc></url><url><loc>https://n.test/x</loc></url><url><loc>https://n.test/op/1</loc></url><url><loc>https://n.test/op/2</loc></url></urlset>'
    found = spark.createDataFrame([(xml,)], "xml string").select(F.posexplode(Wb.sitemap_urls("xml")).alias("pos", "url"))
    assert [r["url"] for r in found.orderBy("pos").collect()] == ["https://n.test/op/1", "https://n.test/x", "https://n.test/op/2"]
    pages = spark.createDataFrame([("https://n.test/op/2", PAGE), ("https://n.test/op/1", "<p>corto</p>")], "url string, html string").withColumns({"fetched_at": F.current_timestamp(), "path": F.lit("p")})
    rows = Wb.collect_columns(found, pages, Source("col", "sitemap_column", url_include=["/op/"], limit=2)).collect()
    assert [(r["url"], r["metadata"]["listing_rank"]) for r in rows] == [("https://n.test/op/2", "2")]  # a short page isn't made up for
    fragment = r'<article><h2>Versión <b>estenográfica<\/b><\/h2><a href=\"\/presidencia\/1\">x<\/a><time date=\"2026-06-01\"><\/time><\/article>\n<article><h2>Otra<\/h2><a href=\"\/o\">y<\/a><\/article>'
    items = spark.createDataFrame([(fragment,)], "f string").select(F.explode(Wb.archive_items(F.col("f"), "https://g.test", "Versión")).alias("i")).select("i.*").collect()
    assert [tuple(r) for r in items] == [("Versión estenográfica", "https://g.test/presidencia/1", "2026-06-01")]


@pytest.mark.parametrize("url", ["file:///etc/passwd", "ftp://news.test/a", "http://../private", "http://%31%32%37.0.0.1/x", "http://localhost/", "http://a.localhost/", "http://127.0.0.1/", "http://127.1/", "http://2130706433/", "http://0x7f000001/", "http://169.254.169.254/", "http://[::1]/", "http://u:p@n.test/", "http://n.test:99999/", "http://n.test/\r\nx", "", "  "])
def test_unsafe(url):
    with pytest.raises(Wb.UnsafeURL):
        Wb.safe_url(url)


def test_safe_and_redirects():
    assert Wb.safe_url("https://news.test/a?b#c") and Wb.safe_url("http://8.8.8.8/")
    assert Wb.safe_redirect("http://a.test/", "https://b.test/x") == "https://b.test/x"
    with pytest.raises(Wb.UnsafeURL):
        Wb.safe_redirect("https://a.test/", "http://b.test/")
    assert Wb.safe_addresses(["8.8.8.8", "8.8.8.8"]) == ["8.8.8.8"]
    for bad in (["8.8.8.8", "10.0.0.1"], [], ["x"]):
        with pytest.raises(Wb.UnsafeURL):
            Wb.safe_addresses(bad)
    assert Wb.valid_user_agent("collector/1.0 (+https://press.test/contact)") and not Wb.valid_user_agent("bot https://example.com") and not Wb.valid_user_agent("x")


def test_robots():
    can = lambda rules: rules.can_fetch("agent", "https://n.test/a")
    for status, text in ((404, ""), (None, ""), (200, ""), (200, "# only\n# comments"), (200, "<html></html>")):
        assert not can(Wb.robots_rules(status, text)) and can(Wb.robots_rules(status, text, allow_unavailable=True))
    for status in (401, 403):
        assert not can(Wb.robots_rules(status, "", allow_unavailable=True))
    assert not can(Wb.robots_rules(None, refused=True, allow_unavailable=True))
    assert not can(Wb.robots_rules(200, "User-agent: *\nDisallow: /a")) and can(Wb.robots_rules(200, "User-agent: *\nDisallow: /b"))


def test_fetcher():
    web = {"https://a.test/robots.txt": (200, b"User-agent: *\nAllow: /", None), "https://a.test/x": (302, b"", "https://b.test/y"), "https://b.test/robots.txt": (200, b"User-agent: *\nDisallow: /y", None), "https://a.test/ok": (200, "sí".encode(), None), "https://a.test/loop": (302, b"", "/loop"), "https://a.test/big": (200, b"x" * 99, None)}
    asked = []

    def get(url, address, agent, limit):
        asked.append(url)
        return web[url]

    fetcher = Wb.Fetcher(get, lambda host, port: ["10.0.0.1"] if host == "in.test" else ["8.8.8.8"], "collector/1.0 (+https://press.test/c)", max_bytes=50)
    assert fetcher.fetch("https://a.test/ok") == ("sí", None, False)
    with pytest.raises(PermissionError):
        fetcher.fetch("https://a.test/x")
    assert "https://b.test/y" not in asked
    with pytest.raises(Wb.UnsafeURL):
        fetcher.fetch("https://a.test/loop")
    with pytest.raises(OverflowError):
        fetcher.fetch("https://a.test/big")
    with pytest.raises(PermissionError):
        fetcher.fetch("https://in.test/x")  # robots can't be read safely, so all is denied


def test_url_columns(spark):
    rows = spark.createDataFrame([("https://n.test/a",), ("http://localhost/",), ("ftp://x",), ("http://127.1/",), (None,), ("http://8.8.8.8/x",), ("http://172.20.1.1/",), ("http://10.0.0.1:80/",), ("http://n.test:8080/a",)], "url string").select(Wb.is_safe_url("url").alias("s"), Wb.cache_path("url").alias("p")).collect()
    assert [r["s"] for r in rows] == [True, False, False, False, False, True, False, False, True] and rows[8]["p"].startswith("n.test_8080/") and rows[0]["p"].startswith("n.test/") and rows[0]["p"].endswith(".html")


AGENT = "collector/1.0 (+https://press.test/c)"
ROBOTS = Wb.Response(200, b"User-agent: *\nAllow: /")


def test_requests_go_to_the_checked_address():
    """One resolution for each request; the next checked address if one fails; nothing is sent to a name that changed to a local one."""
    answers, sent, names = [["8.8.8.8"], ["9.9.9.9", "8.8.4.4"], ["10.0.0.1"]], [], []

    def resolve(host, port):
        names.append((host, port))
        return answers[len(names) - 1]

    def get(url, address, agent, limit):
        sent.append((url, address))
        if address == "8.8.4.4":
            raise OSError("no answer")
        return ROBOTS if url.endswith("robots.txt") else Wb.Response(200, b"page")

    fetcher = Wb.Fetcher(get, resolve, AGENT)
    assert fetcher.fetch("https://n.test/a")[0] == "page"
    assert sent == [("https://n.test/robots.txt", "8.8.8.8"), ("https://n.test/a", "9.9.9.9")]
    with pytest.raises(Wb.UnsafeURL):
        fetcher.fetch("https://n.test/b")  # robots are known; the name now leads to a local address
    assert len(sent) == 2 and names == [("n.test", 443)] * 3
    answers.append(["8.8.4.4", "9.9.9.9"])
    assert fetcher.fetch("https://n.test/c")[0] == "page" and [a for _, a in sent[2:]] == ["8.8.4.4", "9.9.9.9"]


def test_delay_cache_and_limits(tmp_path):
    now, waits, sent = [0.0], [], []

    def get(url, address, agent, limit):
        sent.append(url)
        return ROBOTS if url.endswith("robots.txt") else Wb.Response(200, "sí".encode("latin-1"), None, "latin-1")

    make = lambda **k: Wb.Fetcher(get, lambda h, p: ["8.8.8.8"], AGENT, cache_dir=str(tmp_path), delay=1.0, clock=lambda: now[0], sleep=waits.append, **k)
    fetcher = make()
    text, path, cached = fetcher.fetch("http://n.test:81/a")
    assert text == "sí" and not cached and "n.test_81" in path and waits == [1.0]
    assert fetcher.fetch("http://n.test:81/a") == ("sí", path, True) and len(sent) == 2
    assert not fetcher.fetch("http://n.test:81/a", use_cache=False)[2] and len(sent) == 3
    with pytest.raises(OverflowError):
        make(max_bytes=1).fetch("http://n.test:81/a")
    parts = iter([b"x" * 10] * 3 + [b""])
    with pytest.raises(OverflowError):
        collect.read_limited(lambda n: next(parts), None, 25)
    with pytest.raises(OverflowError):
        collect.read_limited(lambda n: pytest.fail("read"), "26", 25)
    assert Wb.decoded("é".encode(), "no-such-set") == "é"


def test_transport_keeps_host_and_address():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "text/plain; charset=latin-1")
            self.end_headers()
            self.wfile.write(f"{self.headers['Host']} {self.path} {self.headers['User-Agent']}".encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    answer = collect.get(f"http://no-such-name.test:{port}/a?b=1", "127.0.0.1", AGENT, 1000)
    server.shutdown()
    assert answer == Wb.Response(200, f"no-such-name.test:{port} /a?b=1 {AGENT}".encode(), None, "latin-1")


def test_one_bad_feed_has_no_items(spark):
    rows = spark.createDataFrame([("<rss><broken",), (FEED,), (None,)], "xml string").select(F.size(Wb.feed_items("xml")).alias("n")).collect()
    assert [r["n"] for r in rows] == [0, 2, 0]


def test_url_include_is_a_text_or_a_list(spark):
    urls = spark.createDataFrame([("https://n.test/opinion/a",), ("https://n.test/zzz",)], "url string")
    for include, kept in (("/opinion/", 1), (["/opinion/", "zzz"], 2), (None, 2), ([], 0)):
        assert urls.where(Wb.allowed_url("url", include)).count() == kept


def test_collection_from_the_configuration(spark, tmp_path):
    sitemap = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://n.test/op/1</loc></url><url><loc>https://n.test/x</loc></url><url><loc>https://n.test/op/2</loc></url></urlset>'
    archive = r'<article><h2>Versión uno<\/h2><a href=\"\/p\/1\">x<\/a><time date=\"2026-06-01\"><\/time><\/article>'
    pages = {
        "https://n.test/feed": FEED, "https://n.test/map": sitemap, "https://n.test/op/2": PAGE, "https://www.gob.mx/p/1": PAGE, "https://n.test/arch?p=1": archive, "https://n.test/arch?p=2": "",
        "https://n.test/list": '<a href="/op/2">a</a><a href="/other">b</a>',
    }
    asked = []

    def get(url, address, agent, limit):
        asked.append(url)
        if url.endswith("robots.txt"):
            return ROBOTS
        return Wb.Response(200, pages[url].encode()) if url in pages else Wb.Response(404)

    config = AppConfig(project=Project(user_agent=AGENT, database_path=str(tmp_path / "s"), cache_dir=str(tmp_path / "c"), output_dir=str(tmp_path / "o")))
    config.sources = [
        Source("feed", "rss_feed", True, "press", feed_url="https://n.test/feed", fetch_article=False, min_text_chars=5),
        Source("column", "sitemap_column", True, "press", sitemap_url="https://n.test/map", url_include="/op/"),
        Source("list", "listing_column", True, "press", listing_url="https://n.test/list", url_include=["/op/"]),
        Source("gov", "gob_presidency", True, "official_government", archive_url="https://n.test/arch?p={page}", max_pages=2, title_include="Versión"),
        Source("off", "rss_feed", feed_url="https://n.test/off"), Source("odd", "unknown", True),
    ]
    fetcher = Wb.Fetcher(get, lambda h, p: ["8.8.8.8"], AGENT)
    assert [type(c).__name__ for c in collect.build_collectors(config, fetcher)] == ["FeedCollector", "ColumnCollector", "ColumnCollector", "ArchiveCollector"]
    rows = {(r["source_name"], r["url"]): r for r in collect.collect(spark, config, fetcher).collect()}
    assert set(rows) == {("feed", "https://n.test/1"), ("feed", "https://n.test/2"), ("column", "https://n.test/op/2"), ("list", "https://n.test/op/2"), ("gov", "https://www.gob.mx/p/1")} - {("feed", "https://n.test/2")} | {k for k in rows if k == ("feed", "https://n.test/2")}
    assert rows[("column", "https://n.test/op/2")]["metadata"]["listing_rank"] == "2" and str(rows[("gov", "https://www.gob.mx/p/1")]["published_at"])[:10] == "2026-06-01"
    assert "https://n.test/off" not in asked and "https://n.test/x" not in asked
    config.sources = config.sources[:2]
    engine = Engine(spark, config)
    assert engine.collect(fetcher) == engine.documents().count() > 1
    ident = rows[("column", "https://n.test/op/2")]["id"]
    assert engine.get_document(ident).first()["url"] == "https://n.test/op/2" and engine.get_document("none").count() == 0
    config.sources = [Source("off", "rss_feed", feed_url="https://n.test/off")]
    assert collect.collect(spark, config) is None  # and no agent is asked for
    with pytest.raises(ValueError):
        collect.build_collectors(AppConfig(sources=[Source("gov", "gob_presidency", True)]), fetcher)
