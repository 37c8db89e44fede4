from tests.llm.conftest import rows
from tidegrid.llm.url_filter import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.b.c", "/x", "allow"),
         ("b.c", "/x/y", "block"), ("B.C", "/x/y/z", "allow"), ("b.c", "/x/y/z", "block")]
URLS = [None, "", "no scheme", "http://Example.ORG/es/1?x#y", "http://www.example.org/en/1", "https://example.org/en/2",
        "http://example.org", "http://notexample.org/es/", "http://q.a.b.c/x/y", "http://b.c/x/y/zz", "http://b.c/x", "x://org/#", "a://b://c",
        "http://example.org/es", "http://EXAMPLE.org?x/es/"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v == "block", h.lower() + p, v) for h, p, v in RULES
            if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_matches_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    urls = URLS + URLS[3:6] * 3
    pages = spark.createDataFrame([(i // 2, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, host int")
    got = rows(judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), slice_rows=2))
    assert sorted(got, key=repr) == sorted([(i // 2, *brute(u)) for i, u in enumerate(urls)], key=repr)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert rows(judge_urls(pages, rules)) == []
    some = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert rows(judge_urls(some, rules.limit(0), default="block")) == [(1, "a.org", "/", None, "block")]


def test_a_host_of_very_many_labels(spark):
    urls = ["http://" + "a." * 20_000 + end for end in ("org/x", "b.c/x/y", "net/", "example.org/es/" + "p" * 50_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")))
    assert sorted(got) == [(i, *brute(u)) for i, u in enumerate(urls)]
