import re

import duckdb
import pytest

from paperloom.llm.queries import op4_url_filters
from paperloom.llm.url_filters import RULES, oracle, url_filters


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule(url):
    host, path = parts(url)
    fits = [(len(r), r, v) for r, v in RULES for name, _, rest in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://WWW.Example.com/en/1", "http://example.com/en/", "http://m.example.com/en/x", "http://a.com", "http://a.com/", "https://b.net/fr/1?x=://y/", "b.net/fr/", None, "", "http://x.net/en", "http://x.net:80/es/#a", "http://É.com/", "x://y://z", "http://1.2.3.4/a", "http://a.b.co.uk/x", "://", "http://notexample.com/en/"]


def test_hosts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[0]), (0, URLS[0])], "page_id long, url string")
    outcomes = spark.createDataFrame([(0, 1), (3, 0), (None, 1)], "page_id long, bad int")
    got = url_filters(pages, outcomes).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r.page_id or 0]
        assert (r.host, r.path) == parts(url)
        assert (r.rule, r.verdict) == rule(url) if rule(url)[0] else r.rule is None and r.verdict in ("allow", "block")
    assert url_filters(pages.limit(0), outcomes).count() == 0
    assert {r.verdict for r in url_filters(pages, outcomes.limit(0)).filter("rule IS NULL").collect()} <= {"allow"}


def test_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.org/{i}") for i in range(200)] + [(500, "http://new.bad.org/"), (501, "http://other.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(200)], "page_id long, bad int")
    got = {r.host: r for r in url_filters(pages, outcomes).collect()}
    assert got["bad.org"].verdict == "block" and got["good.org"].verdict == "allow"
    assert got["good.org"].bad_mean < got["other.org"].bad_mean < got["new.bad.org"].bad_mean < got["bad.org"].bad_mean


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equal_to_sql(spark, sf):
    rows = op4_url_filters(spark, sf)
    columns = sorted(rows.columns)
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle()})").fetchall()
    assert sorted(repr(tuple(r)) for r in rows.select(columns).collect()) == sorted(map(repr, expected))


def test_salted_join_and_second_levels(spark, monkeypatch):
    import paperloom.llm.url_filters as module

    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://a.com.hk/"), (90, "http://b.com.hk/x"), (91, "http://b.zz.hk/x")], "page_id long, url string")
    outcomes = spark.createDataFrame([(0, 1), (90, 1), (91, 0)], "page_id long, bad int")
    plain = sorted(map(repr, url_filters(pages, outcomes).collect()))
    monkeypatch.setattr(module, "BROADCAST_HOSTS", 0)
    assert sorted(map(repr, url_filters(pages, outcomes).collect())) == plain
    hosts = pages.select("page_id", module.host_of(pages.url).alias("host"))
    names = lambda **more: {r.host: (r.domain, r.suffix) for r in hosts.select("host", *(c.alias(n) for c, n in zip(module._parts(hosts.host, **more), ("domain", "suffix"), strict=True))).collect()}
    assert names()["b.com.hk"] == ("b.com.hk", "com.hk") and names()["a.b.co.uk"] == ("b.co.uk", "co.uk") and names()["b.zz.hk"] == ("zz.hk", "hk")
    assert names(second_level=("zz",))["b.zz.hk"] == ("b.zz.hk", "zz.hk")
