"""Links of pages and redirect equivalence at some size, against brute force."""

import random
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from relmill.llm import url_filter as U

BASE = "http://h.org/a/b/c.html?q=1#top"
LINKS = ["x.html", "./x", "../y", "../../../z", "/r/../s/./t", "?page=2", "#top", "", "//other.net/p/../q", "https://e.com", "https://e.com/a/./b?c=../d", "mailto:me@h.org", "javascript:void(0)", "d/", "..", ".", "a/..", "p?x=/../y#z"]


@pytest.mark.parametrize("base", [BASE, "http://h.org", "http://h.org/", "https://h.org/f?x#y"])
def test_links_resolve_by_rfc_3986(spark, base):
    rows = spark.createDataFrame([(i, base, x) for i, x in enumerate(LINKS)], "i int, u string, l string").select("i", U.address(U.resolved(F.col("u"), F.col("l"))).alias("r"))
    got = [r.r for r in rows.orderBy("i").collect()]
    want = []
    for link in LINKS:
        if link.startswith(("mailto:", "javascript:")):
            want.append(None)
            continue
        # urljoin leaves the dots of absolute links; RFC 3986 removes them as well
        link = {"//other.net/p/../q": "//other.net/q", "https://e.com/a/./b?c=../d": "https://e.com/a/b?c=../d"}.get(link, link)
        full = urldefrag(urljoin(base, link))[0] if link not in ("", "#top") else urldefrag(base)[0]
        want.append(full)
    assert [g and g.rstrip("/") for g in got] == [w and w.rstrip("/") for w in want]


def test_attributes_are_whole(spark):
    pages = [
        ("http://p.org/1", '<link data-href="http://bad.org/" href="http://ok.org/1" rel="canonical">', ["http://ok.org/1"]),
        ("http://p.org/2", '<LINK title="a>b" REL="alternate canonical" HREF=http://ok.org/2>', ["http://ok.org/2"]),
        ("http://p.org/3", "<link rel='stylesheet' href='/x'><linked rel=canonical href=/no>", []),
        ("http://p.org/4", '<!-- <link rel=canonical href=/no> --><meta http-equiv="Refresh" content="0; URL=/four?a=1&amp;b=2">', ["http://p.org/four?a=1&b=2"]),
        ("http://p.org/5", '<meta name="x" content="0;url=/no"><meta http-equiv=refresh content="5">', []),
        ("http://p.org/6", '<link rel="canonical" href="mailto:a@b.c"><link rel="canonical">', []),
        (None, '<link rel="canonical" href="http://ok.org/">', []), ("no address", '<link rel="canonical" href="/x">', []), ("http://p.org/7", None, []),
    ]
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string, m string")
    got = sorted((r.src, r.dst) for r in U.page_edges(df).collect())
    assert got == sorted((u, d) for u, _, ds in pages for d in ds)


def test_blocks_spread_over_long_chains_and_hubs(spark):
    r = random.Random(4)
    n = 3000
    rules = [("bad.org", "/", "block"), ("good.org", "/", "allow")]
    hosts = ["p.org"] * 20 + ["good.org", "bad.org"]
    urls = [f"http://{r.choice(hosts)}/{i}" for i in range(n)]
    chain = [(i, i + 1) for i in range(0, 600)]  # one chain, one hub, many small groups
    hub = [(i, 1000) for i in range(1001, 1900)]
    pairs = [(r.randrange(2000, n), r.randrange(2000, n)) for _ in range(500)]
    edges = chain + hub + pairs
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    blocked = {find(i) for i in range(n) if "bad.org" in urls[i]}
    in_edges = {x for e in edges for x in e}
    want = {}
    for i, u in enumerate(urls):
        own = "block" if "bad.org" in u else "allow" if "good.org" in u else None
        want[i] = own or ("block" if i in in_edges and find(i) in blocked else "allow")
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(n + i, None, None) for i in range(50)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(urls[a], urls[b]) for a, b in edges], "src string, dst string")
    got = {x.page_id: x.verdict for x in U.url_filter(pages, rules, redirects).collect()}
    assert got == want | {n + i: "allow" for i in range(50)} and "block" in {want[i] for i in range(n) if "p.org" in urls[i]}
    assert U.url_filter(pages.limit(0), rules, redirects).count() == 0 and U.url_filter(pages, []).where("verdict = 'block'").count() == 0
