"""URL filters against plain rules, a plain PageRank and the SQL twin."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from jobtables.llm.url_filters import ORACLE_SQL, RULES, UNITS, Rule, host_scores, judge_urls

SCHEMA = "page_id long, url string, html string"


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split(r"[?#]", rest[cut:], maxsplit=1)[0]


def plain_rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host))
           and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text)) if fit else None


def plain_scores(rows, rounds=40):
    """Shares of both walks by dense rounds in floating point."""
    seeds = {"trust": {}, "distrust": {}}
    links = {}
    for _, url, html in rows:
        host, path = plain_split(url)
        r = plain_rule(host, path)
        if r and host:
            s = seeds["trust" if r.verdict == "allow" else "distrust"]
            s[host] = s.get(host, 0) + 1
        for t in set(re.findall(r'<a href="(?:https?:)?//([^/"]*)', html or "")):
            t = t.lower()
            if host and t and t != host:
                links[host, t] = links.get((host, t), 0) + 1
    out = {}
    for walk, seed in seeds.items():
        edges = {(a, b) if walk == "trust" else (b, a): w for (a, b), w in links.items()}
        deg = {}
        for (a, _), w in edges.items():
            deg[a] = deg.get(a, 0) + w
        now = {h: n / sum(seed.values()) for h, n in seed.items()}
        total = dict(now)
        for _ in range(rounds):
            new = {}
            for (a, b), w in edges.items():
                if a in now:
                    new[b] = new.get(b, 0) + 0.85 * now[a] * w / deg[a]
            now = new
            for h, v in now.items():
                total[h] = total.get(h, 0) + v
        z = sum(total.values())
        out[walk] = {h: v / z for h, v in total.items()}
    return out


def plain(rows):
    scores = plain_scores(rows)
    out = []
    for page, url, _ in rows:
        host, path = plain_split(url)
        r = plain_rule(host, path)
        bad = scores["distrust"].get(host, 0) > scores["trust"].get(host, 0)
        out.append((page, host, path, r.text if r else None,
                    r.verdict if r else ("block" if bad else "allow")))
    return sorted(out, key=str)


def web(seed, n=400):
    """Random pages of linked hosts, with a hub, rule edges and odd urls."""
    rnd = random.Random(seed)
    hosts = [f"{s}{w}.example.{t}" for w in ("ab", "cd", "ef", "gh", "ij", "kl")
             for t in ("com", "net", "org") for s in ("", "www.")] + ["example.org", "org", "xorg"]
    rows = []
    for i in range(n):
        host = rnd.choice(hosts) if rnd.random() < 0.7 else "hub.example.net"
        path = rnd.choice(["", "/", "/es/", "/es", "/en/1", "/en/17", "/en/2", "/fr/3", "/de/4", "/de"])
        tail = rnd.choice(["", "?q=http://x.org/fr/", "#/de/", "?a#b"])
        targets = rnd.sample(hosts, rnd.randint(0, 4)) + ([host.upper()] if rnd.random() < 0.2 else [])
        html = "<p>" + "".join(f'<a href="{rnd.choice(["http://", "//", "https://"])}{t}/z">x</a>'
                               for t in targets * rnd.randint(1, 2)) + '<a href="/own">y</a>'
        rows.append((i, f"http://{host.upper() if rnd.random() < .1 else host}{path}{tail}", html))
    return rows


def as_rows(df):
    return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict"))
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_walks_and_sql(spark, seed, tmp_path):
    rows = web(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_rows(judge_urls(df, RULES))
    assert got == plain(rows)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}
    con = duckdb.connect()
    import pandas as pd
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841
    con.execute("CREATE TABLE pages AS SELECT * FROM pages")
    cols = "page_id, host, path, rule, verdict"
    assert sorted(con.execute(f"SELECT {cols} FROM ({ORACLE_SQL})").fetchall(), key=str) == got


def test_shares_and_split_hubs(spark):
    rows = web(3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_scores(rows)
    for r in host_scores(df, RULES).collect():
        assert abs(r.trust - want["trust"].get(r.host, 0)) < 1e-9
        assert abs(r.distrust - want["distrust"].get(r.host, 0)) < 1e-9
    from jobtables.llm.shared import Scratch
    from jobtables.llm.url_filters import spread
    links = spark.createDataFrame(
        [("t", "hub", f"h{i}", 1 + i % 3) for i in range(500)]
        + [("t", f"h{i}", "hub", 1) for i in range(0, 500, 2)], "walk string, src string, dst string, pages long")
    seeds = spark.createDataFrame([("t", "hub", 3), ("t", "h1", 1)], "walk string, host string, n long")
    a, b = (sorted(map(tuple, spread(links, seeds, Scratch(spark, "t"), 0.85, 6, per_key=k).collect()))
            for k in (7, 10_000))
    assert a == b and len(a) == 501
    assert next(m for _, h, m in a if h == "h1") >= UNITS // 4


def test_odd_rows_clashing_names_and_empty_table(spark):
    rows = [(1, None, None), (2, "no scheme", '<a href="http://x.org">'), (None, "http://a.org/x", ""),
            (3, "x://", None), (4, "http://EXAMPLE.org/es/?", None), (4, "http://EXAMPLE.org/es/?", None),
            (5, "http://a.org", None), (6, "http://com/fr/", "<a href='http://y.net'>"),
            (7, "http://y.net/" + "z" * 50_000, "<a " + "q" * 200_000),
            (8, "http://b://c.org/", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("host", "path", "rule", "verdict", "walk", "mass", "spread", "src")})
    got = as_rows(judge_urls(df, RULES))
    assert got == plain(rows)
    assert got[0][1:] == ("", "", None, "allow")
    empty = judge_urls(df.limit(0), RULES)
    assert empty.collect() == [] and empty.columns == ["page_id", "host", "path", "rule", "verdict"]
    with pytest.raises(ValueError):
        judge_urls(df, [Rule("a", "/", "allow")] * 1_001)
