import random

from countweave.llm import url_filter as U


def plain(url, rules):
    """Every rule is tried."""
    host, path = U.split(url)
    best = None
    for r in rules:
        if isinstance(r, U.HostRule) and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


URLS = [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.Net/x", "https://foonet/", "http://b.example.net/en/1?q#f", "http://b.example.net/EN/1", "http://example.net?x/en/", "x://example.com/de/", "x://sub.example.com/de", "x://org/fr/", "x://a.org/fr/2", "x://a.org#/fr/", "http://a.net:80/", "http://ünet/", "http://é.net/", "a://b://c.net/", "http://x.net\n/en/", "http://a.xyz/cheap-pills/", "http://cheap-pills.com/"]


def test_rules(spark):
    rules = (*U.RULES, U.HostRule("allow", "b.example.net", "/en"), U.PatternRule("block", "any q", r"\?q"))
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, Rule string, host int")
    got = U.judge(df, rules=rules).collect()
    assert len(got) == 2 * len(URLS)
    for row in got:
        want = plain(row.url, rules)
        assert (row.host, row.path) == U.split(row.url)
        assert row.rule == (want.name if want else None), row
        if want:
            assert row.verdict == want.action
        else:
            assert row.verdict == ("block" if row.url and ("pills" in row.url or "?q" in row.url) else "allow")


def test_every_rule_waits_under_its_rarest_token():
    rules = (U.HostRule("block", "a.common", "/x/y"), U.PatternRule("block", "p", "q"))
    assert U.index(rules, {"common": 9, "a": 3, "x": 1}) == {"x": [0], None: [1]}
    assert rules[0].tokens() == {"a", "common", "x"}


def test_candidates_lose_no_rule(spark):
    r = random.Random(3)
    parts = ["a", "b", "net", "org", "example"]
    rules = tuple(U.HostRule(r.choice(["block", "allow"]), ".".join(r.sample(parts, 2)), r.choice(["/", "/en", "/en/", "/en/a"])) for _ in range(20))
    urls = ["http://" + ".".join(r.sample(parts, 3)) + r.choice(["", "/", "/en", "/en/", "/en/ab", "/EN/"]) for _ in range(300)]
    for row in U.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=rules).collect():
        want = plain(row.url, rules)
        assert row.rule == (want.name if want else None)


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
