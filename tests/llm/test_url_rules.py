import random
import re

import pytest

from tuplequarry.llm.url_rules import RULES, match_urls, rules_frame


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def check(spark, urls, rules, **kw):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "'x' as k", "2 as salt")
    got = sorted(map(tuple, match_urls(df, rules_frame(spark, rules), **kw).collect()))
    assert got == sorted((i, *brute(u, rules)) for i, u in enumerate(urls))


def test_fixed_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://com/en/x", "HTTP://WWW.Example.COM/en/77?x=/de/", "https://a.example.com/en/7", "http://example.net/de/8#f", "http://x.net/de/", "http://xnet/de/", "http://org/es", "http://a.org./es/1", "http://e.org:80/es/", "http://example.com?/en/7", "x://y://com/en/", "http://ex\n.com/en/a\nb", "http://.com/en/"]
    check(spark, urls, RULES)


def test_many_rules_and_tiles(spark):
    r = random.Random(5)
    name = lambda n: ".".join(r.choice("ab") + r.choice(["", "a"]) for _ in range(n))
    path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randrange(5)))
    rules = [("it's.a\\b", "/'", "block"), *{(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((name(r.randint(1, 3)), path()) for _ in range(300))}.values()]
    urls = [f"http://{name(r.randint(1, 4))}{path()}" for _ in range(400)]
    check(spark, urls, rules)
    check(spark, urls, rules, tile=8, salts=3)
    check(spark, urls, rules, tile=2, salts=2)  # more than 64 tiles
    with pytest.raises(ValueError, match="repeat"):
        match_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), rules_frame(spark, [*rules, rules[0]]))


def test_repeats_and_none(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, "http://a.b.com/en/7")], "page_id long, url string")
    out = match_urls(df, rules_frame(spark), salts=2)
    assert sorted(r.verdict for r in out.collect()) == ["block"] * 3
    assert match_urls(df.limit(0), rules_frame(spark)).count() == 0
    assert {r.verdict for r in match_urls(df, rules_frame(spark, [])).collect()} == {"allow"}


def test_rules_are_the_contracts(spark):
    """Written out here again: the other tests take RULES as they are."""
    assert sorted(RULES) == [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.net", "/de/8", "block"), ("net", "/de/", "allow"), ("org", "/es/", "block")]
    urls = ["http://a.net/de/x", "http://example.net/de/7", "http://b.example.net/de/81", "http://a.com/en/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in match_urls(df, rules_frame(spark)).collect())
    assert got == [(0, "net/de/", "allow"), (1, "net/de/", "allow"), (2, "example.net/de/8", "block"), (3, "com/en/", "block")]
