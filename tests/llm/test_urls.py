import re

from barlake.llm import urls

URLS = [
    "http://a.example.com/en/1?x#y", "HTTPS://B.Example.COM/en/7abc", "http://m.b.example.com/fr/1", "x.example.com/en/2", None, "", "://", "http://",
    "http://q.example.net/de/8", "http://q.example.net/de/9#z", "http://net/de/1", "http://xnet/de/1", "ftp://é.ÉX.org/es/1?q=://z", "http://c.org?en/x",
    "http://d.example.org/es/", "http://d.example.org/ES/", "http://e.com", "http://e.com/en", "http://user@h.com:80/en/2\n://x", "a://b://c/d", "http://b.example.com/fr/2",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(n + p, a) for a, n, p in urls.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def brute_force(rows):
    """Rules, then dense power iteration over the same edges."""
    parsed = [(i, *split(u), h) for i, u, h in rows]
    hosts = sorted({h for _, h, _, _ in parsed if h})
    edge = {}
    links = {(h, m.lower()) for _, h, _, html in parsed for m in re.findall(r"""(?:href|src)\s*=\s*["']?\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/"'?#\s>]+)""", html or "", re.I) if h}
    per_page = [(h, {m for m in re.findall(urls.LINK.replace("(?i)", ""), html or "", re.I)}) for _, h, _, html in parsed if h]
    for h, own in per_page:
        for m in own:
            m = m.lower()
            if m in hosts and m != h:
                edge[h, m] = edge.get((h, m), 0) + 1
    assert all((a, b) in links for a, b in edge)
    for h in hosts:
        up = h.partition(".")[2]
        if up in hosts and up != h:
            edge[h, up] = edge.get((h, up), 0) + 1
            edge[up, h] = edge.get((up, h), 0) + 1

    def rank(edges, seeds):
        total = sum(seeds.values()) or 1
        start = {h: n / total for h, n in seeds.items()}
        r = dict(start)
        ends = set(hosts) - {a for a, _ in edges}
        for _ in range(300 if seeds else 0):
            # A step from a host without links leads to a seed, like a jump.
            lost = sum(x for h, x in r.items() if h in ends)
            nxt = {h: x * (1 - urls.DAMPING + urls.DAMPING * lost) for h, x in start.items()}
            for (a, b), w in edges.items():
                out = sum(v for (x, _), v in edges.items() if x == a)
                nxt[b] = nxt.get(b, 0) + urls.DAMPING * r.get(a, 0) * w / out
            r = nxt
        return r

    seeds = {"allow": {}, "block": {}}
    for _, h, p, _ in parsed:
        a = rule_of(h, p)[1]
        if a:
            seeds[a][h] = seeds[a].get(h, 0) + 1
    trust, bad = rank(edge, seeds["allow"]), rank({(b, a): w for (a, b), w in edge.items()}, seeds["block"])
    out = []
    for i, h, p, _ in parsed:
        rule, action = rule_of(h, p)
        out.append((i, h, p, rule, action or ("block" if round(bad.get(h, 0) - trust.get(h, 0), 12) > 0 else "allow")))
    return out


def test_equals_brute_force(spark):
    html = ['<a href="http://B.example.com/x">', "<a href='//d.example.org'><img src=//q.example.net/1.png>", None, '<a href="/local">', '<a HREF = "https://e.com?x"><a href="https://e.com">']
    rows = [(i, u, html[i % len(html)]) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = [tuple(r) for r in urls.verdicts(df).collect()]
    want = brute_force(rows)
    assert sorted(got) == sorted(want, key=lambda r: r[0])
    assert {"allow", "block"} == {r[4] for r in want if r[3] is None}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    # Each host links to the next, the last to a blocked one; distrust runs back over all 20 links.
    rows = [(i, f"http://h{i}.xyz/a", f'<a href="http://h{i + 1}.xyz/a">') for i in range(20)] + [(20, "http://h20.xyz/a", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.verdicts(df, rules=(("block", "h20.xyz", "/"),)).collect()}
    assert got == {i: "block" for i in range(21)}


def test_of_rules_of_equal_length_the_first_wins(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", None), (2, "http://b.a.com/xy", None)], "page_id long, url string, html string")
    rules = (("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("allow", "com", "/"), ("block", "a.com", "/xy"))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.verdicts(df, rules=rules).collect()}
    assert got == {1: ("a.com/x", "block"), 2: ("a.com/xy", "block")}


def test_distrust_is_not_lost_at_hosts_without_links(spark):
    # Half of the trust flows to a host without links; both sides still add up to one.
    html = '<a href="http://good.xyz/"><a href="http://bad.xyz/">'
    rows = [(1, "http://seed.xyz/a", '<a href="http://end.xyz/"><a href="http://mid.xyz/">'), (2, "http://end.xyz/", None), (3, "http://mid.xyz/", html), (4, "http://bad.xyz/", None), (5, "http://good.xyz/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = spark.createDataFrame([("seed", "end", 1.0), ("seed", "mid", 1.0), ("mid", "bad", 2.0)], "src string, dst string, weight double")
    rank = urls.propagate(edges, spark.createDataFrame([("seed", 1.0)], "host string, mass double"), 0.85, 12, "t")
    assert abs(rank.agg({"rank": "sum"}).first()[0] - 1) < 1e-12
    assert {r.page_id for r in urls.verdicts(df, rules=(("allow", "seed.xyz", "/"), ("block", "bad.xyz", "/"))).collect() if r.verdict == "block"} == {3, 4}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1", None)], "page_id long, url string, html string")
    out = urls.verdicts(df)
    assert "Python" not in out._jdf.queryExecution().toString() and out.collect()[0].verdict == "block"


def test_empty_table(spark):
    assert urls.verdicts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
