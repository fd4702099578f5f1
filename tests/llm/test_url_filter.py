from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarry.llm.queries import URL_RULES, op1_url_filter
from quarry.llm.url_filter import match_urls

RULES = "host string, path string, verdict string"


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:k])
    path = rest[k:].split("?")[0].split("#")[0]
    fits = [(len(h + (p or "")), len(h), v == "block", h + (p or ""), v) for h, p, v in rules if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_plain_reading(spark):
    rng = random.Random(3)
    labels, paths = ["a", "b", "www", "com", "net", "example", "com:80", "É"], ["", "/", "/en/", "/en/7", "/en/77?x#y", "?q", "#f", "/de/8/x"]
    urls = [(k, rng.choice(["http://", "HTTPS://", "x"]) + ".".join(rng.choices(labels, k=rng.randint(1, 5))) + rng.choice(paths)) for k in range(3000)]
    urls += [(3000 + k, "http://hot.example.com/en/7") for k in range(1500)] + [(5000, None), (5001, ""), (5002, "://"), (5003, "http://"), (5003, "http://")]
    rules = URL_RULES + [(".".join(rng.choices(labels[:6], k=rng.randint(1, 3))), rng.choice(["", "/", "/en/", "/en/7", "/de"]), rng.choice(["allow", "block"])) for _ in range(60)] + [("", "/", "block"), (None, "/", "block"), ("com", None, "allow"), ("a.com", "/", None)]
    got = match_urls(spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")), spark.createDataFrame(rules, RULES)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, *plain(u, rules)) for k, u in urls], key=str)


def test_empty_tables(spark):
    urls = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in match_urls(urls, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert match_urls(urls.where("false"), none).count() == 0


def test_query(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()
    assert sorted(map(tuple, op1_url_filter(spark, data).collect())) == sorted((r["page_id"], *plain(r["url"], URL_RULES)) for r in pages)


def test_very_long_urls(spark):
    urls = [(1, "http://" + "a." * 200_000 + "example.com/en/7" + "x" * 300_000), (2, "http://net/de/" + "y" * 500_000 + "?" + "z" * 500_000), (3, "http://" + "n" * 400_000), (4, "x" * 300_000 + "://com/en/")]
    got = match_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(URL_RULES, RULES)).collect()
    assert sorted(map(tuple, got)) == [(k, *plain(u, URL_RULES)) for k, u in urls]
