import duckdb

from relforge.llm import url_templates as u


def judged(spark, urls):
    df = spark.createDataFrame([(k, x, "h") for k, x in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: r for r in u.filter_urls(df).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme/x", "HTTP://A.Example.NET/en/1", "http://net/x", "http://x.net", "http://xnet/y", "https://example.com/de/7?q=/fr/", "https://a.example.com/DE/7",
        "x://b.org/fr/9#f", "x://b.org?fr/", "://host", "http://É.com/Ä b", "http://example.net/en", "http://a.net/p://q",
    ]
    got = judged(spark, urls)
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.net", "/en/1", "example.net/en/"), ("net", "/x", "net/"), ("x.net", "", None), ("xnet", "/y", None),
        ("example.com", "/de/7", "example.com/de/"), ("a.example.com", "/DE/7", None), ("b.org", "/fr/9", "org/fr/"), ("b.org", "", None), ("host", "", None), ("É.com", "/Ä b", None),
        ("example.net", "/en", "net/"), ("a.net", "/p://q", "net/"),
    ]
    for k in (3, 4, 7, 9, 13):
        assert got[k].verdict == ("allow" if k in (3, 9) else "block")


def urls_of_a_tree():
    urls = [f"http://s{k % 3}.casino-x.com/en/{k}" for k in range(30)]
    urls += [f"http://news.example.com/{lang}/{k}{end}" for lang in ("de", "en", "fr") for k in range(25) for end in ("", ".html")]
    urls += [f"http://mild.example.com/{lang}/{k}" for lang in ("de", "en") for k in range(1)]
    urls += [f"http://big.org/{k}/deadbeef{k:08x}/{'t' * 25}/leaf" for k in range(5)] + ["http://big.org/fr/1"] * 40
    urls += [f"http://forum.com/promo/{name}/deals/a/b" for name in ("casino-night", "best-bets", "cheap-pills", "Casino", "bets4u", "mega-casino", "pills-now", "spring")]
    urls += [f"http://forum.com/talk/{name}/x" for name in ("alpha", "beta", "gamma", "delta", "casino-law", "epsilon", "zeta")]
    return urls + [None, None, "x" * 100_000, "http://" + "y" * 50_000 + "/z"]


def test_templates(spark):
    urls = urls_of_a_tree()
    got = judged(spark, urls)
    by_url = {u: got[k] for k, u in enumerate(urls) if u}
    assert all(r.verdict == "block" and r.template.endswith("com/en/{n}") for r in got.values() if "casino" in r.host)
    assert by_url["http://news.example.com/de/3"].verdict == "block" and by_url["http://news.example.com/en/3"].verdict == "allow"  # a rule is no evidence beside its path
    assert by_url["http://mild.example.com/en/0"].verdict == "allow"
    assert by_url["http://big.org/3/deadbeef00000003/" + "t" * 25 + "/leaf"].template.startswith("big.org/")
    spring = by_url["http://forum.com/promo/spring/deals/a/b"]  # without a listed word, in a branch that is nearly all bad
    assert spring.verdict == "block" and not spring.is_bad_word and spring.template == "forum.com/promo/*/deals/a/b"
    assert {r.template for u, r in by_url.items() if "/talk/" in u} == {"forum.com/talk/*/x"}  # slugs become one wildcard
    assert all(r.verdict == "allow" for u, r in by_url.items() if "/talk/" in u)  # one bad word in a good branch is too little


def test_given_labels(spark):
    urls = [f"http://a.com/{'shop' if k % 2 else 'blog'}/p{k}/view" for k in range(60)] + ["http://a.com/shop/other/view", "http://a.com/blog/other/view"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0), (None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in u.filter_urls(df, labels=labels).collect()}
    assert got[61].verdict == "allow" and got[60].verdict == "block" and len(got) == 62  # neither labelled nor seen
    assert got[60].template == "a.com/shop/*/view"


def test_against_sql(spark):
    urls = urls_of_a_tree()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    rel = con.sql(u.oracle_sql())
    want = sorted(map(str, (dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())))
    assert sorted(str({c: r[c] for c in rel.columns}) for r in judged(spark, urls).values()) == want


def test_empty_table(spark):
    assert judged(spark, []) == {}
