import datetime as dt
import gzip
import hmac
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from auditloom.session import written
from auditloom.sinks import report_files, tables
from auditloom.sources import crawl as cr
from auditloom.sources.fetch import GuardedFetcher
from auditloom.sources.snapshots import read_snapshots, write_snapshots
from auditloom.streaming import events as ev

SITE = {
    "https://a.example/robots.txt": (200, "text/plain", b"User-agent: *\nDisallow: /private\nCrawl-delay: 5\nSitemap: https://a.example/map.xml\n"),
    "https://a.example/map.xml": (200, "text/xml", b"<sitemapindex><sitemap><loc>https://a.example/sub.xml</loc></sitemap></sitemapindex>"),
    "https://a.example/sub.xml": (200, "text/xml", b'<urlset xmlns="x"><url><loc>https://a.example/s1/</loc></url><url><loc>https://b.example/no</loc></url></urlset>'),
    "https://a.example": (200, "text/html; charset=utf-8", b'<a href="/one">1</a><a href="/private/x">p</a><a href="/gone">g</a><a href="/file.pdf">f</a>'),
    "https://a.example/one": (200, "text/html", b'<a href="/">home</a><a href="/two#x">2</a>'),
    "https://a.example/two": (200, "text/html", b"<p>end</p>"),
    "https://a.example/file.pdf": (200, "application/pdf", b"%PDF"),
}


def _fetcher(site):
    def fetch(url):
        if url == "https://a.example/gone":
            raise OSError("no route")
        return site.get(url, (404, "text/html", b"missing"))

    return fetch


fetch = _fetcher(SITE)


def test_robots_and_sitemaps():
    robots = cr.read_robots(fetch, "https://a.example/x", "auditloom")
    assert not robots.allows("auditloom", "https://a.example/private/x") and robots.allows("auditloom", "https://a.example/x")
    assert robots.delay == 5 and robots.pause(cr.Limits()) == 5 and cr.Robots(delay=0.01).pause(cr.Limits()) == 0.2 and cr.Robots().pause(cr.Limits()) == 0.5
    assert cr.sitemap_pages(fetch, "https://a.example", robots.sitemaps) == ["https://a.example/s1"]
    assert cr.read_robots(fetch, "https://none.example/", "x").allows("x", "https://none.example/private")
    assert cr.sitemap_locations(b"not xml") == ([], []) and cr.sitemap_locations(b"<!DOCTYPE x [<!ENTITY a 'b'>]><urlset/>") == ([], [])
    assert cr.sitemap_locations(gzip.compress(SITE["https://a.example/map.xml"][2])) == (["https://a.example/sub.xml"], [])


def test_crawl_rounds(spark):
    seeds = spark.createDataFrame([("A", "t", "https://a.example")], "audit_id string, tenant_id string, url string")
    pages = {r.url: r for r in cr.crawl(seeds, fetch, wait=lambda s: None).collect()}
    assert set(pages) == {f"https://a.example{p}" for p in ("", "/s1", "/one", "/gone", "/file.pdf", "/two")}
    assert [u[17:] for u in sorted(pages, key=lambda u: pages[u].place)] == ["", "/s1", "/one", "/gone", "/file.pdf", "/two"]
    assert pages["https://a.example/gone"].error_message == "no route" and pages["https://a.example/file.pdf"].html is None
    capped = cr.crawl(seeds, fetch, cr.Limits(pages=2), wait=lambda s: None)
    assert sorted(r.url for r in capped.collect()) == ["https://a.example", "https://a.example/s1"]
    summary = cr.crawl_summary(cr.crawl(seeds, fetch, wait=lambda s: None)).first()
    assert (summary.total_pages, summary.total_fetched, summary.total_errors, summary.failed) == (6, 4, 2, False)
    assert cr.crawl(seeds.limit(0), fetch).count() == 0


def test_links_are_taken_in_order_of_discovery(spark):
    site = {"https://a.example": b'<a href="/z">z</a><a href="/a">a</a>', "https://a.example/z": b'<a href="/y">y</a>', "https://a.example/a": b'<a href="/b">b</a>'}
    seeds = spark.createDataFrame([("A", "t", "https://a.example/")], "audit_id string, tenant_id string, url string")
    pages = cr.crawl(seeds, lambda u: (200, "text/html", site[u]) if u in site else (404, "", b""), cr.Limits(pages=4), wait=lambda s: None)
    assert {r.url: r.place for r in pages.collect()} == {"https://a.example": 0, "https://a.example/z": 1, "https://a.example/a": 2, "https://a.example/y": 3}


def test_crawls_that_fail(spark):
    rows = [("A", "https://a.example"), ("B", "https://a.example/private/x"), ("C", "ftp://c.example"), ("D", None), ("E", "https://e.example"), ("F", "http://[x")]
    seeds = spark.createDataFrame([(a, "t", u) for a, u in rows], "audit_id string, tenant_id string, url string")
    start = written(cr.seeded(seeds, fetch), "t")
    pages = cr.crawl(seeds, fetch, wait=lambda s: None, start=start)
    got = {r.audit_id: r.reason for r in cr.crawl_failures(start, pages).collect()}
    assert got == {"B": cr.DISALLOWED, "C": cr.NO_ADDRESS, "D": cr.NO_ADDRESS, "E": cr.NO_PAGE, "F": cr.NO_ADDRESS}


def test_guarded_fetcher():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            step = int(self.path[2:]) if self.path.startswith("/r") else 0
            self.send_response(302 if step else 200)
            if step:
                self.send_header("Location", f"/r{step - 1}")
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"x" * 100)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"http://site.example:{server.server_port}"
        local = dict(resolve=lambda host, port: ["127.0.0.1"], timeout=5)
        free = GuardedFetcher(blocked=lambda ip: False, body_bytes=10, **local)
        assert free(root + "/r5") == (200, "text/html; charset=utf-8", b"x" * 10)
        for url, guarded in ((root + "/r6", free), (root, GuardedFetcher(**local)), ("ftp://site.example", free), ("http://[x", free)):
            with pytest.raises(OSError):
                guarded(url)
        mixed = GuardedFetcher(resolve=lambda host, port: ["93.184.216.34", "10.0.0.1"])
        with pytest.raises(OSError, match="10.0.0.1"):
            mixed("https://site.example/")
    finally:
        server.shutdown()
        server.server_close()


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, "{}", "<p>ä</p>"), ("A", 2, None, "")], "audit_id string, version int, json string, html string")
    made = written(report_files.write_report_files(rows, str(tmp_path)), "t")
    tokens = {r.version: r.share_token for r in made.collect()}
    assert len(set(tokens.values())) == 2 and all(len(t) == 32 for t in tokens.values())
    read = lambda *a: report_files.read_report_file(made, str(tmp_path), *a)
    assert read(tokens[1]) == ("<p>ä</p>".encode(), "text/html; charset=utf-8") and read(tokens[1], "json") == (b"{}", "application/json")
    assert read(tokens[2], "json")[0] == b"" and read("none") is None and (tmp_path / "A" / "v2" / "report.html").exists()
    assert report_files.signature(b'{"a":1}', "1700000000", "s") == hmac.new(b"s", b'1700000000.{"a":1}', "sha256").hexdigest()


def test_crawl_follows_a_long_chain(spark):
    def chain(url):
        k = int(url.rpartition("/p")[2]) if "/p" in url else 0
        return 200, "text/html", f'<a href="/p{k + 1}">next</a>'.encode() if k < 23 else b"end"

    seeds = spark.createDataFrame([(a, "t", "https://a.example") for a in ("A", None)], "audit_id string, tenant_id string, url string")
    pages = cr.crawl(seeds, lambda url: (404, "", b"") if url.endswith("robots.txt") else chain(url), wait=lambda s: None)
    urls = ["https://a.example", *(f"https://a.example/p{k}" for k in range(1, 24))]
    assert sorted((r.audit_id or "", r.url) for r in pages.select("audit_id", "url").collect()) == sorted((a, u) for a in ("", "A") for u in urls)


def test_snapshots_round_trip(spark, tmp_path):
    html = "<p>grüße</p>"
    pages = spark.createDataFrame([("A", "https://a.example/", html), ("A", "https://a.example/none", None)], "audit_id string, url string, html string")
    assert write_snapshots(pages, str(tmp_path)) == 1 and write_snapshots(pages, str(tmp_path)) == 1
    (tmp_path / "A" / "bad.html.gz").write_bytes(b"no gzip")
    got = {r.storage_path: r.html for r in read_snapshots(spark, str(tmp_path)).collect()}
    assert got == {cr.snapshot_path("A", "https://a.example/"): html, "A/bad.html.gz": None}


def test_writers_may_run_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("A", "onpage", 1), ("B", "onpage", 2)], "audit_id string, category string, n int")
    tables.replace_partitions(rows, path, ["audit_id", "category"])
    tables.replace_partitions(rows.where("audit_id = 'A'").withColumn("n", F.lit(9)), path, ["audit_id", "category"])
    assert sorted((r.audit_id, r.n) for r in spark.read.parquet(path).collect()) == [("A", 9), ("B", 2)]
    assert [r.n for r in tables.read_audit(spark, path, "A", ["n"]).collect()] == [9]
    new = spark.createDataFrame([("A", "onpage", 3), ("C", "onpage", None)], rows.schema)
    assert sorted((r.audit_id, r.n) for r in tables.upserted(rows, new, ["audit_id"], "n").where("n is not null").collect()) == [("A", 3), ("B", 2)]


T0 = dt.datetime(2025, 1, 1)


def test_barrier_batch_and_stream(spark, tmp_path):
    kinds = ["a", "b", "c"]
    rows = [("k1", "c"), ("k1", "a"), ("k1", "a"), ("k1", "b"), ("k2", "a"), ("k2", "b"), ("k3", "b"), ("k3", "a"), ("k3", "c"), ("k3", "zzz")]
    for k, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, "key string, kind string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("key string, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = ev.barrier_stream(stream, kinds).writeStream.format("memory").queryName("barrier").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.monotonic() + 60  # with a processing-time timeout the query goes on for ever
        while spark.table("barrier").count() < 2 and time.monotonic() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(r.key for r in spark.table("barrier").collect()) == ["k1", "k3"]
    timed = spark.createDataFrame([(*r, T0 + dt.timedelta(seconds=k)) for k, r in enumerate(rows)], "key string, kind string, at timestamp")
    assert sorted((r.key, r.completed_at.second) for r in ev.completed(timed, "key", "kind", kinds, "at").collect()) == [("k1", 3), ("k3", 8)]


def test_repeats_are_dropped_in_streams_and_tables(spark, tmp_path):
    rows = [("m1", T0), ("m2", T0), ("m1", T0 + dt.timedelta(minutes=1))]
    df = spark.createDataFrame(rows, "msg_id string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert ev.without_repeats(df).count() == 2
    stream = ev.event_stream(spark, str(tmp_path / "in"), "msg_id string, ts timestamp")
    q = ev.without_repeats(stream).writeStream.format("memory").queryName("repeats").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.msg_id for r in spark.sql("select * from repeats").collect()) == ["m1", "m2"]


def test_deliveries_are_made_once(spark, tmp_path):
    schema = "audit_id string, channel string"
    spark.createDataFrame([("A", "email"), ("A", "email"), ("B", "email")], schema).write.parquet(str(tmp_path / "in"))
    sent: list[str] = []
    log = [("B", "email", "delivered")]

    def send(batch):
        sent.extend(r.audit_id for r in batch.collect())
        return batch.withColumn("status", F.lit("delivered"))

    for run in ("one", "two"):
        q = ev.deliver_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: spark.createDataFrame(log, schema + ", status string"), send, lambda df: log.extend(tuple(r) for r in df.collect()), str(tmp_path / run))
        assert q.awaitTermination(120)
    assert sent == ["A"]


def test_token_bucket(spark):
    rows = [(k, u, T0 + dt.timedelta(seconds=s)) for k, (u, s) in enumerate([("a", 0), ("a", 0), ("a", 0), ("a", 1), ("b", 0), ("a", 5)])]
    got = ev.admitted(spark.createDataFrame(rows, "id int, user string, ts timestamp"), "user", "ts", rate=1, burst=2)
    assert {r.id: r.allowed for r in got.collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    assert ev.admitted(spark.createDataFrame([], "id int, user string, ts timestamp"), "user", "ts", 1, 2).count() == 0
