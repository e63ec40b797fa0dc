import fnmatch

import pytest

from panelweave.llm.queries import URL_GLOBS, URL_RULES
from panelweave.llm.url_filter import Automaton, Rule, judge_urls

URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=/de/", "http://org", "http://x.org/", "notorg/", None, "", "no scheme", "http://b.com/fr/x#y", "http://b.com/de/",
    "http://evil.net/x.example.org/es/", "http://shop.net/a/login", "http://ads.b.net", "http://track12.b.net/", "http://track123.b.net/", "://h/p", "http://\u00e9.org/\u4e2d", "x://y://z.org/",
    "http:///only/path", "http://big-casino.net/", "http://my.casino/", "http://b.net/" + "q" * 5000 + ".zip",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
    return host, path.split("#")[0].split("?")[0]


def plain(url):
    host, path = parts(url)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    for r in sorted(URL_GLOBS, key=lambda r: -len(r.name)):
        ends = [host, *[host[i + 1 :] for i, c in enumerate(host) if c == "."]]
        if any(fnmatch.fnmatchcase(h, r.host) for h in ends) and fnmatch.fnmatchcase(path, r.path + "*"):
            return host, path, None, r.verdict
    return host, path, None, "allow" if host else "block"


def test_against_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, None, None, None), (1, URLS[1], "h", "v")], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, URL_RULES, URL_GLOBS).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)} | {None: ("", "", None, "block")}
    assert judge_urls(pages, URL_RULES, URL_GLOBS).count() == len(URLS) + 2
    assert judge_urls(pages.limit(0), URL_RULES, URL_GLOBS).count() == 0


@pytest.mark.parametrize("n", [1, 3, 40])
def test_rules_longer_than_a_word(n):
    rules = [Rule("host%d.net" % i, "/" + "p" * (13 * i) + "*z", "block") for i in range(n)]
    a = Automaton(rules)
    urls = [(b"sub.host%d.net" % i, b"/" + b"p" * (13 * j) + b"abz-rest") for i in range(n) for j in range(n)]
    got = a.matches(urls)
    assert [bool(got[k, i]) for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(n))] == [j >= i for i in range(n) for j in range(n)]
    assert got.sum() == n * (n + 1) // 2
