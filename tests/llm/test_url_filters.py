"""Rules, edges and components against plain Python."""

import random
import re

from talkloom.llm import url_filters as uf
from talkloom.llm.components import connected_components

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(url):
    host, path = host_path(url)
    fits = [(-len(h + p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[1:] if fits else (None, None)


class Groups:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def judged(pages, edges):
    groups = Groups()
    for a, b in edges:
        if a is not None and b is not None:
            groups.join(a, b)
    seen = {}
    for node in list(groups.up):
        seen.setdefault(groups.root(node), set()).add(rule_of(node)[1])
    out = []
    for page, url in pages:
        rule, verdict = rule_of(url)
        found = seen.get(groups.root(url), set()) if url in groups.up else set()
        out.append((page, *host_path(url), rule, verdict or ("allow" if "allow" in found else "block" if "block" in found else "allow")))
    return sorted(out, key=str)


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    shapes = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(0, i) for i in range(1, 400)] + [(500, 0)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "loops": [(1, 1), (2, 2), (2, 3), (3, 2), (2, 3)],
    }
    for edges in shapes.values():
        groups = Groups()
        for a, b in edges:
            groups.join(a, b)
        frame = spark.createDataFrame([*edges, (None, 7), (8, None)], "u int, v int")
        got = sorted((r["node"], r["component"]) for r in connected_components(frame).collect())
        assert got == sorted((x, groups.root(x)) for x in groups.up)
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.example.net", "EXAMPLE.net", "b.net", "x.example.com", "example.com", "site.org", "net", "example.net.evil", "plain.edu", ""]
    paths = ["", "/", "/en/a", "/de/b?x=1", "/fr/c#f", "/EN/a", "/en"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths] + [None, "no scheme", "x://y://z/en/"]
    pages = [(i, urls[i % len(urls)]) for i in range(150)] + [(None, "http://b.net/"), (3, urls[3])]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(25)] + [("http://hub.edu/", u) for u in urls[:30] if u]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, verdict string")
    got = uf.judge(frame, spark.createDataFrame(edges, "url string, alias string"), uf.rule_table(spark))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()), key=str) == judged(pages, edges)


def test_blocks_reach_aliases_unless_one_is_allowed(spark):
    pages = [
        (1, "http://front.edu/x", '<link rel="canonical" href="https://bad.net/y">'),
        (2, "http://other.edu/x", "<LINK href='//bad.net/z' rel=canonical>"),
        (3, "https://bad.net/z", ""),
        (4, "http://free.edu/", '<meta http-equiv="refresh" content="0; url=http://example.net/en/a">'),
        (5, "http://example.net/en/a", '<meta property="og:url" content="https://bad.net/q">'),
        (6, "http://lone.edu/a/b?utm_source=x", '<link rel="canonical" href="c">'),
        (7, "https://www.lone.edu/a/c/#top", None),
        (8, "mailto:x", '<link rel="canonical" href="javascript:1">'),
    ]
    got = {r["page_id"]: r for r in uf.judge_pages(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert {k: got[k]["verdict"] for k in got} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
    assert got[6]["component"] == got[7]["component"] is not None and got[8]["component"] is None
    assert uf.judge_pages(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
