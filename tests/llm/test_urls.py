"""Operator 2 against a loop over all rules, and against its SQL."""

import re

import duckdb
import pytest

from pagewright.llm import urls


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(.*)", url or "")
    host, path, tail = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2], m[3]) if m else ("", "", "")
    fits = []
    for verdict, rule in urls.HOST_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    block = (host or path) and any(re.search(p, host + path + tail) for _, p, _ in urls.PATTERN_RULES)
    return host, path, None, "block" if block else "allow"


URLS = [None, "", "nothing", "http://", "http://NET/", "http://net", "http://a.net?x", "HTTPS://A.Example.NET/en/x", "http://example.net/en", "http://xexample.net/en/1", "http://example.com/de/", "http://m.example.com/de/x?utm_source=a", "http://m.example.com/fr/x?utm_source=a", "http://m.example.com/fr/?PHPSESSID=1", "http://m.example.com/fr/?a;phpsessid=1", "http://a.org/fr/#t", "http://org/fr/login", "http://a.edu/login", "http://a.edu/login.php#x", "http://a.edu/logins", "http://a.edu/x?print=1&y", "http://a.edu/x?print=10", "a://b://c.net/", "http:///net/", "http://é.net/é?\n#utm_source=", "http://net./", "a?utm_source=1://h.com/p", "a#b://h.com/?utm_source=1", "http://example.net/en", "http://example.net/enough/", "http://example.net/en/%2Fx", "http://a.org/fr/" + "long/" * 260_000 + "?utm_medium=x", "http://a.edu/" + "x" * 1_200_000 + "?utm_medium=x"]


def test_odd_urls(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "x"), (3, "http://NET/", "x"), (3, "http://NET/", "x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(u))) for i, u, _ in rows)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = urls.rule_table(spark, [("block", "ads.example.com/")], [("p", "x", ("zeta", "com"))])
    tokens = spark.createDataFrame([("example",)] * 3 + [("com",)] * 5 + [("ads",)], "token string")
    assert {r.rule: r.token for r in urls.index_rules(rules, tokens).collect()} == {"ads.example.com/": "ads", None: "zeta"}
    # A path's token counts if the rule itself ends it.
    paths = urls.rule_table(spark, [("allow", "example.net/en/"), ("allow", "example.com/de"), ("block", "org/a-b/Cc/d")], [])
    assert {r.rule: r.tokens for r in paths.collect()} == {"example.net/en/": ["example", "net", "en"], "example.com/de": ["example", "com"], "org/a-b/Cc/d": ["org", "a", "b", "cc"]}
    rare = spark.createDataFrame([("example",)] * 3 + [("net",)] * 5 + [("en",)], "token string")
    assert {r.token for r in urls.index_rules(paths.filter("rule = 'example.net/en/'"), rare).collect()} == {"en"}
    with pytest.raises(ValueError):
        urls.rule_table(spark, [], [("everything", "x|y", ())])


def test_every_registered_rule_has_a_token():
    assert all(tokens and all(re.search(t, regex) for t in tokens) for _, regex, tokens in urls.PATTERN_RULES)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    expect = con.execute(f"select {', '.join(cols)} from ({urls.oracle()})").fetchall()
    got = [tuple(r) for r in urls.op2_url_filter(spark, sf).select(*cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expect))
