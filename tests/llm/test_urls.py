"""Verdicts of the path-template tree against a plain tree in Python."""

from __future__ import annotations

import math
import re
from collections import defaultdict

from test_queries import LOWER, SF, rows

from chronoply.llm import queries, urlfilter

NUM = {name: re.compile(p) for name, p in urlfilter.CLASSES}


def general(segment: str) -> str:
    stem, ending = re.match(r"(?s)^(.*?)(\.[A-Za-z0-9]{1,5})?$", segment).groups()
    return next((name + (ending or "") for name, p in NUM.items() if p.search(stem)), segment)


def brute(urls: list[str | None], rules, depth=6, many=20, rare=0.5, weight=2.0, same=1.96, reject=0.7, least=3):
    """(host, path, rule, verdict) of each url."""
    parts = []
    for url in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        parts.append((host, path, max(fits, key=lambda r: len(r.name), default=None)))
    segs = [["/".join(map(general, p.split("/"))).lstrip("/").split("/")][0] for _, p, _ in parts]
    chains = [[""] for _ in parts]
    for k in range(depth):
        kids = defaultdict(lambda: defaultdict(int))
        for (host, _, _), s, c in zip(parts, segs, chains, strict=True):
            if len(s) > k:
                kids[host, c[-1]][s[k]] += 1
        wide = {n for n, v in kids.items() if len(v) >= many and len(v) >= rare * sum(v.values())}
        for (host, _, _), s, c in zip(parts, segs, chains, strict=True):
            if len(s) > k:
                c.append(f"{c[-1]}/{'*' if (host, c[-1]) in wide else s[k]}")
    for s, c in zip(segs, chains, strict=True):
        if len(s) > depth:
            c.append(c[-1] + "/**")
    labels = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    total = [0, 0]
    for (host, _, rule), c in zip(parts, chains, strict=True):
        for k, node in enumerate(c):
            children[host, k, c[k - 1] if k else None].add(node)
            if rule:
                labels[host, k, node][rule.verdict == "block"] += 1
        if rule:
            total[rule.verdict == "block"] += 1
    branch = {}
    for (host, k, _), nodes in children.items():
        cells = defaultdict(list)
        for n in nodes:
            g, b = labels[host, k, n]
            if g + b:
                cells[b * urlfilter.STEPS // (g + b)].append(n)
        groups, last = [], None
        for cell in sorted(cells):
            g, b = (sum(labels[host, k, n][x] for n in cells[cell]) for x in (0, 1))
            if last:
                n, m = g + b, sum(last)
                p = (b + last[1]) / (n + m)
                if abs(b / n - last[1] / m) > same * math.sqrt(p * (1 - p) * (1 / n + 1 / m)):
                    groups.append([])
            else:
                groups.append([])
            groups[-1].append((cells[cell], g, b))
            last = (g, b)
        for group in groups:
            for names, _, _ in group:
                for n in names:
                    branch[host, k, n] = (sum(x[1] for x in group), sum(x[2] for x in group))
    out = []
    for (host, path, rule), c in zip(parts, chains, strict=True):
        rate, told = (total[1] + 1) / (sum(total) + 2), None
        for k, node in enumerate(c):
            if (host, k, node) in branch:
                g, b = branch[host, k, node]
                rate = (b + weight * rate) / (g + b + weight)
                if g + b >= least:
                    told = rate
        out.append((host, path, rule and rule.name, rule.verdict if rule else "block" if told is not None and told >= reject else "allow"))
    return out


def test_the_query_is_the_plain_tree(spark):
    pages = rows("pages")
    want = brute([p["url"] for p in pages], queries.URL_RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op3_url_templates(spark, SF).collect()}
    assert got == {p["page_id"]: w for p, w in zip(pages, want, strict=True)}


RULES = [urlfilter.Rule("block", "shop.org", "/sale/"), urlfilter.Rule("block", "shop.org", "/promo/"), urlfilter.Rule("allow", "shop.org", "/news/"), urlfilter.Rule("allow", "good.org", "/a/")]


def urls() -> list[str | None]:
    made = [f"http://shop.org/{x}/{k}.html" for x in ("sale", "promo") for k in range(12)] + [f"http://shop.org/news/{k}" for k in range(3)]
    made += ["http://shop.org/other/1", "http://shop.org/sale", "http://good.org/b/1", "http://none.org/x", None, "", "no scheme", "http://shop.org/sale/2024-01-02/" + "x/" * 40]
    return made + [f"http://good.org/a/{k}" for k in range(5)] + [f"http://good.org/u{k}/t" for k in range(60)]


def test_urls_without_a_rule(spark):
    """Both verdicts come from the tree; a host without labels allows."""
    table = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in urlfilter.judge(table, RULES).collect()}
    want = brute(urls(), RULES)
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(want))] == want
    by_url = {u: got[k] for k, u in enumerate(urls())}
    assert (by_url["http://shop.org/other/1"].rule, by_url["http://shop.org/other/1"].verdict) == (None, "block")
    assert {by_url[u].verdict for u in ("http://good.org/b/1", "http://none.org/x", None, "no scheme")} == {"allow"}


def test_alike_siblings_merge(spark):
    """Of three branches two are alike: an unlabelled leaf of either is judged by both."""
    rules = [urlfilter.Rule("block", "a.x", "/p/1"), urlfilter.Rule("block", "a.x", "/q/1"), urlfilter.Rule("allow", "a.x", "/r/")]
    made = ["http://a.x/p/1", "http://a.x/p/1", "http://a.x/q/1", "http://a.x/q/1", "http://a.x/q/zzz"] + [f"http://a.x/r/{k}x" for k in range(9)]
    table = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(table, rules).collect()}
    assert got[4].rule is None and got[4].labels == 4 and got[4].verdict == "block"


def test_purity_on_labels_held_out(spark):
    """Rules that the judge isn't told: their URLs get the same verdict by their siblings' labels."""
    held = [u for k, u in enumerate(urls()[:24]) if k % 4 == 0]
    seen = [r for r in RULES if r.path != "/promo/"]
    table = spark.createDataFrame(list(enumerate(urls()[:24])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(table, seen).collect()}
    assert len(held) == 6 and {got[k] for k in range(0, 24, 4)} == {"block"}
