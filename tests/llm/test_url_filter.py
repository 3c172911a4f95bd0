from siftlab.llm import url_filter

PAGES = "page_id long, url string, host string, rule string"


def judged(spark, urls):
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)]
    return [tuple(r)[1:5] for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


def test_rules_and_terms(spark):
    got = judged(
        spark,
        [
            "https://WWW.Example.com/en/1", "http://a.example.com/en/x?y#z", "http://b.com/x", "http://x.net/es/1", "http://x.net/esx/1",
            "http://casino.org/", "http://casinos.org/", "http://free-pills.org/", "http://free.free.org/", None, "no scheme casino", "http://example.com",
            "http://com/", "x://y.net/fr/?u=://z", "",
        ],
    )
    assert got == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/x", "example.com/en/", "block"),
        ("b.com", "/x", "com/", "allow"),
        ("x.net", "/es/1", "net/es/", "block"),
        ("x.net", "/esx/1", None, "allow"),
        ("casino.org", "/", None, "block"),
        ("casinos.org", "/", None, "allow"),
        ("free-pills.org", "/", None, "block"),
        ("free.free.org", "/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "block"),
        ("example.com", "", None, "allow"),
        ("com", "/", "com/", "allow"),
        ("y.net", "/fr/", "net/fr/", "block"),
        ("", "", None, "allow"),
    ]


def test_empty_and_very_long(spark):
    assert judged(spark, []) == []
    assert judged(spark, ["http://h.org/" + "a" * 200_000 + "/casino"])[0][3] == "block"
