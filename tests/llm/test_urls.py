"""Rules and hosts against plain string work; templates and their purity on planted hosts."""

import random
import re
from collections import Counter, defaultdict
from math import sqrt

import pytest

from faturalens.llm import common, url_templates

ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://EX.Org:80?q=/es/", "http://org/", "http://x.org", "a://example.org/en/12",
    "a://xexample.org/es/", "a://www.example.org/es/1", "http://É.COM/fr/x", "http://a.com/de", "http://a.com/de/#/x", "a://b://c.com/fr/",
    "http://com.net/fr/1", "http://a.com/fr/" + "/".join("abcdefghijk"), "http://a.com//fr/", "http://x.org/\nes/",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for rule, _ in url_templates.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_hosts_paths_and_rules(spark):
    common.prepare(spark)
    source = random.Random(1)
    urls = ODD + ["".join(source.choices(["http://", "example.org", "/", "es/", "en/1", "com", "?", "#", "A."], k=6)) for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS verdict")
    said = dict(url_templates.RULES)
    got = url_templates.judge(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (said[rule] if rule else r["verdict"]) and r["verdict"] in ("allow", "block")
    assert url_templates.judge(pages.limit(0)).collect() == []


def test_templates_and_their_purity(spark):
    rows = [f"http://shop.net/item/{i}" for i in range(60)] + [f"http://shop.net/spam/{i}" for i in range(60)]
    rows += [f"http://shop.net/about/team{i % 2}" for i in range(10)]
    rules = [(f"shop.net/spam/{d}", "block") for d in "12345"] + [(f"shop.net/item/{d}", "allow") for d in "12345"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["path"]: r for r in url_templates.judge(pages, rules).collect()}
    assert got["/spam/9"]["template"] == "/spam/{n}" and got["/spam/9"]["verdict"] == "block" and got["/spam/9"]["rule"] is None
    assert got["/item/9"]["verdict"] == "allow"
    assert got["/about/team1"]["template"] == "/about/team1"


def plain_kind(segment):
    if re.fullmatch("[0-9]+", segment):
        return "{n}"
    if m := re.fullmatch(r"[0-9]+\.([A-Za-z0-9]{1,5})", segment):
        return "{n}." + m[1]
    if re.search("[0-9]", segment) and re.fullmatch("[0-9a-fA-F-]{8,}", segment):
        return "{x}"
    if re.search("[0-9]", segment) and len(segment) >= 12:
        return "{s}"
    return None


def plain_tree(urls, rules):
    """Template, purity and verdict of each (host, path), by one recursion per host."""
    said = dict(rules)

    def rule_of(host, path):
        fit = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fit, key=len) if fit else None

    hosts = defaultdict(Counter)
    for host, path in urls:
        hosts[host][path] += 1
    labels = {(h, p): said.get(rule_of(h, p)) for h in hosts for p in hosts[h]}
    count = lambda h, paths: (sum(hosts[h][p] for p in paths if labels[h, p]), sum(hosts[h][p] for p in paths if labels[h, p] == "block"))
    smooth = lambda b, l, up: (b + 4.0 * up) / (l + 4.0)
    every = [count(h, hosts[h]) for h in hosts]
    base = (sum(b for _, b in every) + 0.5) / (sum(l for l, _ in every) + 1)
    template, rate = {}, {}

    def generalise(h, paths, level):
        groups = defaultdict(list)
        for p in paths:
            parts = re.sub("^/", "", p).split("/")
            if level < len(parts):
                groups[parts[level]].append(p)
        kinds = defaultdict(list)
        for segment in groups:
            kinds[plain_kind(segment)].append(segment)
        nexts = defaultdict(list)
        for k, own in kinds.items():
            urls = sum(hosts[h][p] for s in own for p in groups[s])
            for s in own:
                nexts[k if k and (len(own) >= 4 or urls <= 3 * len(own)) else s] += groups[s]
        for shown, members in nexts.items():
            for p in members:
                template[h, p].append(shown)
            generalise(h, members, level + 1)

    def merge(h, members, level, up, l, b):
        """members: template -> paths, all in one branch."""
        steps = defaultdict(dict)
        for t, paths in members.items():
            steps["/" + t[level] if level < len(t) else ""][t] = paths
        groups = defaultdict(list)
        for step, own in steps.items():
            ol, ob = count(h, [p for paths in own.values() for p in paths])
            rest, pooled = l - ol, (b + 0.5) / (l + 1)
            stands = ol > 0 and rest > 0 and abs(ob / ol - (b - ob) / rest) / sqrt(pooled * (1 - pooled) * (1 / ol + 1 / rest)) >= 2.58
            groups[step if stands else "~"].append((step, own, ol, ob))
        for parts in groups.values():
            gl, gb = sum(x[2] for x in parts), sum(x[3] for x in parts)
            p = smooth(gb, gl, up)
            on = {}
            for step, own, _, _ in parts:
                if step == "":
                    rate.update({(h, t): p for t in own})
                else:
                    on.update(own)
            if on:
                merge(h, on, level + 1, p, gl, gb)

    for h in hosts:
        for p in hosts[h]:
            template[h, p] = []
        generalise(h, list(hosts[h]), 0)
        members = defaultdict(list)
        for p in hosts[h]:
            members[tuple(template[h, p])].append(p)
        l, b = count(h, hosts[h])
        merge(h, members, 0, smooth(b, l, base), l, b)
    return {(h, p): ("/" + "/".join(template[h, p]), rate[h, tuple(template[h, p])], labels[h, p]) for h in hosts for p in hosts[h]}


def test_templates_and_purity_equal_a_plain_tree(spark):
    common.prepare(spark)
    source = random.Random(1)
    hosts = ["a.org", "b.net", "hot.com", "hot.com", "hot.com", ""]
    words = ["item", "spam", "tag", "", "x", "7", "7", "12", "3.html", "9.html", "deadbeef01", "deadbeef02", "long-mixed-slug-1", "long-mixed-slug-2"]
    urls = []
    for _ in range(700):
        length = source.choice([0, 1, 2, 3, 4, 9])
        parts = [source.choice(words) if source.random() < 0.7 else str(source.randint(0, 99)) for _ in range(length)]
        urls.append((source.choice(hosts), "/" + "/".join(parts)))
    urls += [("deep.org", "/" + "a/" * 9 + str(i)) for i in range(9)] + [("deep.org", "/b" + "/1" * 300)] * 2
    rules = [("hot.com/spam/", "block"), ("hot.com/item/", "allow"), ("a.org/7", "block"), ("b.net/x", "allow"), ("org/tag", "block")]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_templates.judge(pages, rules).collect()}
    want = plain_tree(urls, rules)
    for i, key in enumerate(urls):
        template, purity, label = want[key]
        assert (got[i]["template"], got[i]["purity"]) == (template, pytest.approx(purity, abs=1e-12))
        assert got[i]["verdict"] == (label or ("block" if purity > 0.5 else "allow"))


def test_the_plan_grows_by_a_table_a_level(spark):
    common.prepare(spark)

    def size(depth):
        rows = [(i, "http://h.org/" + "/".join(f"w{(i >> level) % 2}" for level in range(depth)) + f"/{i}") for i in range(300)]
        judged = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"))
        assert judged.count() == 300
        return len(judged._jdf.queryExecution().optimizedPlan().toString())

    assert size(8) <= 1.5 * size(2)


def test_a_depth_may_be_given(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a/b/c/d")], "page_id long, url string")
    assert [r["template"] for r in url_templates.judge(pages, depth=2).collect()] == ["/a/b/**"]
