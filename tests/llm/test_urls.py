import hashlib

from pyspark.sql import functions as F

from sightline.llm import urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("b.org", None, "block"), ("b.org", "", "allow")]


def judged(spark, found, rules=RULES):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(found)], "page_id long, url string, block string")
    rows = urls.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return {r["page_id"]: r for r in rows.collect()}


def test_rules(spark):
    found = [
        "http://EXAMPLE.com/en/x?q=/en/7", "http://a.example.com/en/75", "http://notexample.com/en/7", "com/en/", None, "x://com", "http://b.org", "http://c.b.org/zz#f",
        "http://xb.org/", "http://example.com?/en/7", "http://com/EN/", "http://com/en/", "http://com/en/",
    ]
    got = judged(spark, found)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(found))] == [
        ("example.com", "/en/x", "com/en/", "block"), ("a.example.com", "/en/75", "example.com/en/7", "allow"), ("notexample.com", "/en/7", "com/en/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("com", "", None, "allow"), ("b.org", "", "b.org", "allow"), ("c.b.org", "/zz", "b.org", "allow"), ("xb.org", "/", None, "allow"), ("example.com", "", None, "allow"), ("com", "/EN/", None, "allow"),
        ("com", "/en/", "com/en/", "block"), ("com", "/en/", "com/en/", "block"),
    ]
    assert got[0]["block"] == "mine"


def test_empty_tables(spark):
    assert {r["verdict"] for r in judged(spark, ["http://com/en/"], [("x", "/", "block")]).values()} == {"allow"}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert urls.filter_urls(pages, none).first()["verdict"] == "allow"
    assert urls.filter_urls(pages.limit(0), none).isEmpty()


def test_the_filter_passes_all_listed_keys_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = -(-5000 // urls.KEYS_PER_BLOCK)
    table = urls.bloom_blocks(keys, blocks)
    probe = keys.union(spark.range(20_000).select(F.concat(F.lit("other"), "id"))).withColumn("block", urls._block(F.col("key"), blocks))
    hit = F.lit(True)
    for i, mask in enumerate(urls._masks(F.col("key"))):
        hit &= F.col(f"w{i}").bitwiseAND(mask) != 0
    passed = probe.join(table, "block").where(hit)
    assert passed.where("key like 'k%'").count() == 5000
    assert passed.where("key like 'o%'").count() < 200


def test_a_large_list_by_brute_force(spark):
    def token(i):
        return hashlib.md5(str(i).encode()).hexdigest()[:2]

    rules = [(f"{token(i)}.net", f"/{token(i + 500)}", "block") for i in range(300)] + [("net", "/0", "block")]
    found = [f"http://{token(i * 7)}.{token(i * 3)}.net/{token(i)}/x" for i in range(1500)]
    got = judged(spark, found, rules)
    for i, u in enumerate(found):
        host, _, path = u[7:].partition("/")
        fits = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i]["rule"] == (max(fits, key=len) if fits else None)


def test_clashing_columns_and_frequent_urls(spark, monkeypatch):
    from sightline.llm import common

    monkeypatch.setattr(common, "OFTEN", 20)
    names = "best u_host u_path r_host key block salt salts n_rows found_rule found_rows host RULE w0".split()
    found = ["http://a.com/en/1"] * 500 + [None] * 500 + [f"http://{i}.com/x" for i in range(50)] + ["http://b.org/"] * 100
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(found)], "page_id long, url string").withColumns({n: F.lit("mine") for n in names}).repartition(6)
    rows = urls.filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert len(rows) == len(found) and sorted(r["page_id"] for r in rows) == list(range(len(found)))
    assert all(r[n] == "mine" for r in rows for n in names if n not in ("host", "RULE"))
    for r in rows:
        assert r["rule"] == {"http://a.com/en/1": "com/en/", "http://b.org/": "b.org"}.get(found[r["page_id"]])
