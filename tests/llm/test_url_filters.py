import random

from weftline.llm.queries import RULES, url_rules
from weftline.llm.url_filters import judge_urls


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, default)
    return host, path, rule, verdict


def urls(n):
    rng = random.Random(1)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "x.net", "net", "com", "notexample.com", "é.org", "b..com", ""]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/?q=/en/", "/en/a#b", "?x=1", "#/en/"]
    out = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(n)]
    return [*out, None, "", "no scheme", "://", "a://b://net/es/", "http://" + "a." * 300 + "com/" + "p" * 5000]


def test_against_brute_force(spark):
    given = list(enumerate(urls(200)))
    given += given[:5]  # repeated rows
    pages = spark.createDataFrame([(i, u, "clash") for i, u in given], "page_id long, url string, host string")
    want = sorted(((i, *brute(u, RULES)) for i, u in given), key=str)
    for limit in (100, 0):  # broadcast and salted shuffle
        found = judge_urls(pages, url_rules(spark), broadcast_rules=limit)
        assert sorted((tuple(r) for r in found.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want


def test_no_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge_urls(pages, none).first()["verdict"] == "allow"
    assert judge_urls(pages.limit(0), url_rules(spark)).count() == 0
    odd = spark.createDataFrame([(None, "/", "block"), ("com", None, "allow"), ("com", None, "block")], "host string, path string, verdict string")
    row = judge_urls(pages, odd).first()
    assert (row["rule"], row["verdict"]) == ("com", "block")
