"""Hosts, paths and rules against a plain version, and what the tree decides."""

import re

from inductra.llm.queries import URL_RULES, op6_url_filters
from inductra.llm.url_filters import judge_urls


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


def judged(df):
    return {r.page_id: r for r in judge_urls(df, URL_RULES).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme/en/", "http://", "http://COM", "HTTP://Example.Com/en/1?x#y", "https://a.example.com/en/",
        "http://www.example.com/en/x", "http://m.www.example.com/en/x", "http://notexample.com/en/1", "x://a.net/es/#t",
        "http://a.net/fr", "http://a.net/fr/", "http://a.net?/es/", "http://É.Net/es/ü\nz", "a://b://c/d", "http://com/",
        "http://org/" + "x/" * 3000, "http://org/en/1", "http://org/en/1",
    ]
    got = judged(pages(spark, urls).selectExpr("page_id", "url", "'kept' AS host", "1 AS rule", "2 AS template"))
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain(url)
        name, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name)
        assert got[i].verdict in ("allow", "block")
        assert verdict is None or got[i].verdict == verdict


def test_variable_segments_become_wildcards(spark):
    urls = [f"http://a.org/news/{i}" for i in range(40)] + [f"http://a.org/shop/{i}/x" for i in range(40)]
    got = judged(pages(spark, urls))
    assert {got[i].template for i in range(40)} == {"/news/*"}
    assert {got[i].template for i in range(40, 80)} == {"/shop/*/x"}


def test_templates_follow_their_labelled_purity(spark):
    rules = [type(URL_RULES[0])("a.org", "/bad/x", "block"), type(URL_RULES[0])("a.org", "/good/x", "allow")]
    urls = [f"http://a.org/{kind}/x{i}" for kind in ("bad", "good") for i in range(30)]
    urls += [f"http://a.org/{kind}/y{i}" for kind in ("bad", "good") for i in range(30)]
    urls += ["http://b.org/bad/1", "http://b.org/good/1"]
    got = {r.page_id: r for r in judge_urls(pages(spark, urls), rules).collect()}
    assert [got[i].verdict for i in (60, 89, 90, 119)] == ["block", "block", "allow", "allow"]
    assert {got[i].rule for i in range(60, 120)} == {None}


def test_similar_branches_merge(spark):
    rule = type(URL_RULES[0])
    rules = [rule("a.org", f"/{x}/1", "block") for x in "pq"] + [rule("a.org", "/r/1", "allow")]
    urls = [f"http://a.org/{x}/{k}{i}" for x in "pqr" for k in (1, 2) for i in range(20)]
    got = judge_urls(pages(spark, urls), rules).select("path", "template").distinct().collect()
    names = {r.path[1]: r.template.split("/")[1] for r in got}
    assert names == {"p": "p", "q": "p", "r": "r"}


def test_many_equal_sections_keep_their_own_verdict(spark):
    """Each of 40 sections has a 40th of the host's urls; half of them are blocked wherever labelled."""
    rule = type(URL_RULES[0])
    rules = [rule("a.org", f"/s{k:02}/x", "block" if k % 2 else "allow") for k in range(40)]
    urls = [f"http://a.org/s{k:02}/{kind}{k}-{i}" for k in range(40) for kind in "xy" for i in range(4)]
    for r in judge_urls(pages(spark, urls), rules).collect():
        k = int(r.path[2:4])
        assert r.verdict == ("block" if k % 2 else "allow")
        assert r.template == f"/s{k % 2:02}/*"


def test_weak_siblings_do_not_link_opposite_ones(spark):
    """Rates between 0 and 1 in small steps, on few labels, beside two large and pure sections."""
    rule = type(URL_RULES[0])
    labels = {"clean": "a" * 60, "dirty": "b" * 60, "p": "aaa", "q": "aab", "r": "abb", "s": "bbb"}
    rules = [
        rule("a.org", f"/{name}/{verdict}", long)
        for name in labels for verdict, long in (("a", "allow"), ("b", "block"))
    ]
    urls = [f"http://a.org/{name}/{v}{i}" for name, given in labels.items() for i, v in enumerate(given)]
    urls += [f"http://a.org/{name}/z{i}" for name in labels for i in range(3)]
    got = [r for r in judge_urls(pages(spark, urls), rules).collect() if r.rule is None]
    verdicts = {r.path.split("/")[1]: r.verdict for r in got}
    assert (verdicts["clean"], verdicts["dirty"]) == ("allow", "block")


def test_templates_that_differ_deep_down(spark):
    rule = type(URL_RULES[0])
    rules = [rule("a.org", "/a/b/c/d/bad/x", "block"), rule("a.org", "/a/b/c/d/good/x", "allow")]
    urls = [f"http://a.org/a/b/c/d/{kind}/{n}{i}" for kind in ("bad", "good") for n in "xy" for i in range(20)]
    # Here the fork comes behind two others, and one path ends where the rest go on.
    rules += [rule("b.org", f"/p/{k}/q/{v}/x", v) for k in range(3) for v in ("block", "allow")]
    urls += [f"http://b.org/p/{k}/q/{v}/{n}{i}" for k in range(3) for v in ("block", "allow") for n in "xy" for i in range(9)]
    urls += ["http://b.org/p/1/q", "http://b.org/p/1/q", "http://b.org/p/1/q/"]
    got = judge_urls(pages(spark, urls), rules).collect()
    assert len(got) == len(urls)
    for r in got:
        if "bad" in r.path or "block" in r.path:
            assert r.verdict == "block"
        elif "good" in r.path or "allow" in r.path:
            assert r.verdict == "allow"
    assert {r.template for r in got if r.host == "a.org"} == {"/a/b/c/d/bad/*", "/a/b/c/d/good/*"}


def test_empty_table(spark):
    assert judged(pages(spark, [])) == {}


def test_query(spark, sf_dir):
    known = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = op6_url_filters(spark, sf_dir).collect()
    assert len(out) == len(known)
    for r in out:
        host, path = plain(known[r.page_id])
        assert (r.host, r.path) == (host, path)
        name, verdict = plain_rule(host, path)
        assert r.rule == name and (verdict is None or verdict == r.verdict)
