"""URL rules and the spread of trust and distrust, against a plain computation."""

import math
import re
from collections import Counter, defaultdict

import pytest

from jobtrail.llm import queries, url_filter
from tests.llm.odd import SMALL

RULES = [("allow", "com", "/"), ("block", "bad.com", "/"), ("allow", "ok.bad.com", "/x/"), ("block", "net", "/es/"),
         ("block", "com", "/"), ("block", "bad.com", "/"), ("allow", "Upper.ORG", "/")]
SCHEMA = ("page_id long, url string, html string, host int, rule string, trust string, kind int, mass string, rules int, "
          "path int, src int, verdict string")


def page(page_id, url, html=None):
    return (page_id, url, html, 1, "r", "t", 2, "m", 3, 4, 5, "v")


def anchors(*hosts):
    return "<p>" + "".join(f'<a class="x" HREF = "https://{h}/p">{h}</a>' for h in hosts) + "</p>"


PAGES = [
    page(1, "http://bad.com/a", anchors("hub.info", "hub.info")), page(2, "https://www.BAD.com:80/x?y#z"),
    page(3, "https://ok.bad.com/x/1"), page(4, "https://ok.bad.com/y"), page(5, "http://fine.com"),
    page(6, "http://fine.com/", anchors("friend.info") + "<link href='//not-an-anchor.info/'>"),
    page(7, "ftp://hub.info/q", anchors("bad.com", "bad.com", "friend.info")),
    page(8, "http://friend.info/", "<a href=//friend.info/self>self</a><A href='HTTP://Hub.Info'>up</A>"),
    page(9, "http://a.net/es/", "<a href='/local'>here</a>"), page(10, "http://a.net/en/"), page(11, "http://b.a.net/en/es/"),
    page(12, None, anchors("bad.com")), page(13, "no scheme", None), page(None, "http:///only/path"), page(15, "http://?q"),
    page(16, "http://upper.org/z"), page(17, "x://y/z\nw?://v"), page(18, "http://" + "a." * 3000 + "com/" + "p" * 9000),
    page(7, "ftp://hub.info/q", anchors("bad.com", "bad.com", "friend.info")), page(19, "http://com/"),
]


def split_url(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return (lower(found[1]), found[2]) if found else ("", "")


def best_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in ((v, h.lower(), p) for v, h, p in rules)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def plain(pages, rules, rounds=url_filter.ROUNDS):
    """The same definition in loops."""
    rows = [(p[0], *split_url(p[1]), p[2] or "") for p in pages]
    links = Counter()
    for _, host, _, html in rows:
        for tag in re.findall(r"(?i)<(?:a|area)\s[^<>]*", html):
            found = re.search(r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s<>]*)", tag)
            if found and host and found[1] and split_url("://" + found[1])[0] != host:
                links[host, split_url("://" + found[1])[0]] += 1
    known = {h for _, h, _, _ in rows if h} | {h for pair in links for h in pair}
    for host in known:
        parent = host.partition(".")[2]
        if "." in parent and not parent.startswith("."):
            links[host, parent] += 1
            links[parent, host] += 1
    seeds = {"trust": {}, "distrust": {}}
    for host in known:
        verdicts = [best_rule(h, p, rules)[1] for _, h, p, _ in rows if h == host] or [best_rule(host, "/", rules)[1]]
        for kind, verdict in (("trust", "allow"), ("distrust", "block")):
            if 2 * verdicts.count(verdict) > len(verdicts):
                seeds[kind][host] = url_filter.UNIT
    mass = {}
    for kind in seeds:
        ways = {(a, b) if kind == "trust" else (b, a): n for (a, b), n in links.items()}
        out = defaultdict(int)
        for (a, _), n in ways.items():
            out[a] += n
        now = dict(seeds[kind])
        for _ in range(rounds):
            then = defaultdict(int, seeds[kind])
            for (a, b), n in ways.items():
                if a in now:
                    then[b] += math.floor(now[a] * 0.85 * (n / out[a]))
            now = then
        mass[kind] = now
    out = []
    for page_id, host, path, _ in rows:
        rule, verdict = best_rule(host, path, rules)
        trust, distrust = mass["trust"].get(host, 0), mass["distrust"].get(host, 0)
        own = "block" if distrust >= url_filter.UNIT // 2 and distrust > trust else "allow"
        out.append((page_id, host, path, rule, verdict or own, trust, distrust))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("few", [True, False])
def test_against_plain_loops(spark, few, monkeypatch):
    monkeypatch.setattr(url_filter, "SENT_HOSTS", 10_000 if few else 0)
    got = url_filter.judge_urls(spark.createDataFrame(PAGES, SCHEMA), url_filter.rule_frame(spark, RULES), rounds=7)
    want = plain(PAGES, RULES, 7)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    assert ordered(got.collect()) == ordered(want)
    verdicts = {(r[0], r[1]): r[4] for r in want}
    # Linking to a blocked host counts against a host, being linked from one does not.
    assert verdicts[7, "hub.info"] == "block" and verdicts[8, "friend.info"] == "allow"


def test_no_pages_and_no_rules(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert url_filter.judge_urls(empty, url_filter.rule_frame(spark, RULES)).count() == 0
    got = url_filter.judge_urls(spark.createDataFrame(PAGES, SCHEMA), url_filter.rule_frame(spark, [])).collect()
    assert len(got) == len(PAGES) and {(r.rule, r.verdict, r.trust) for r in got} == {(None, "allow", 0)}


def test_a_host_with_a_third_of_all_rows(spark):
    pages = [page(i, "http://hot.info/" + str(i), anchors("bad.com") if i % 2 else None) for i in range(300)]
    pages += [page(i, f"http://h{i}.info/", anchors("hot.info")) for i in range(600)]
    pages += [page(1000, "http://bad.com/")]
    got = url_filter.judge_urls(spark.createDataFrame(pages, SCHEMA), url_filter.rule_frame(spark, RULES))
    assert ordered(got.collect()) == ordered(plain(pages, RULES))


def test_links_are_found_in_linear_time(spark):
    html = "<a " * 200_000 + "href" + "<a href=//x.org>" + "<a href=" * 1000
    found = url_filter.host_links(spark.createDataFrame([("h.org", html)], "host string, html string")).collect()
    assert [tuple(r) for r in found] == [("h.org", "x.org", 1)]


def test_query_is_native(spark):
    got = queries.op11_url_filter(spark, SMALL)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()
    assert ordered(got.collect()) == ordered(plain([tuple(p) for p in pages], queries.URL_RULES))
