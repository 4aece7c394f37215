import re

from pyspark.sql import functions as F

from rillstone.llm import url_filters as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def rule(host, path):
    best = None
    for h, p, verdict in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


URLS = [
    None, "", "no scheme/en/", "http://example.com/en/1", "http://WWW.Example.com/en/1?x#y", "https://a.www.example.com/en/", "http://xexample.com/en/",
    "http://example.com?q=/en/", "http://a.net/es/2", "http://net/fr/", "http://a.net/de/", "http://com", "http://com/", "http://b.org/en/#top", "ftp://x://y/en/",
    "http:///path", "http://É.com/É?é", "http://a.com/x\ny", "http://blog.bad.org/en/12?ref=1", "http://blog.bad.org/fr/7?ref=2",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = {r["page_id"]: r for r in U.judge(pages, labels, F.col("quality") == 0).collect()}
    for i, url in enumerate(URLS):
        name, verdict = rule(*parts(url))
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (*parts(url), name, verdict or "allow"), url


def learned(spark):
    pages, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        pages.append((i, f"http://{'m.casino' if bad else 'm.news'}.org/{'win' if bad or i % 2 else 'read'}/{i}"))
        labels.append((i, 0 if bad else 1))
    pages += [(500, "http://x.casino.org/win/9"), (501, "http://x.casino.org/read/9"), (502, "http://casino.net/es/win/1"), (502, "http://casino.net/es/win/1"), (None, "http://m.casino.org/win/3")]
    return spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_mined_rules_are_those_of_counting(spark):
    pages, labels = learned(spark)
    rules = {tuple(r["tokens"]): (r["confidence"], r["support"]) for r in U.mine(pages, labels, F.col("quality") == 0, 0.05, 0.6).collect()}
    baskets = []
    for r in pages.where("page_id < 120").collect():
        host, path = parts(r["url"])
        baskets.append(({f"h:{x}" for x in host.split(".")} | {"p:" + re.sub("[0-9]+", "0", x) for x in path.split("/") if x}, r["page_id"] % 3 == 0))
    for tokens, (confidence, support) in rules.items():
        held = [bad for t, bad in baskets if set(tokens) <= t]
        assert abs(sum(held) / len(held) - confidence) < 1e-9 and confidence >= 0.6 and abs(sum(held) / len(baskets) - support) < 1e-9
    assert ("h:casino",) in rules and ("p:win",) not in rules and ("h:org",) not in rules


def test_mined_rules_block_what_has_all_tokens(spark):
    pages, labels = learned(spark)
    out = U.judge(pages, labels, F.col("quality") == 0, min_support=0.05).collect()
    verdict = {r["page_id"]: r["verdict"] for r in out}
    assert len(out) == 125 and verdict[500] == verdict[501] == verdict[502] == verdict[None] == verdict[0] == "block" and verdict[1] == "allow"
    assert [r["mined"] for r in out if r["page_id"] == 502] == [None, None]


def test_rules_need_pages(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.org/a") for i in range(30)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i == 3 else 1) for i in range(30)], "doc_id long, quality int")
    assert U.mine(pages, labels, F.col("quality") == 0).count() == 0


def test_labels_that_disagree_or_are_null(spark):
    pages, labels = learned(spark)
    mixed = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality"))).unionByName(spark.createDataFrame([(None, 0), (1, None)], "doc_id long, quality int"))
    assert U.mine(pages, mixed, F.col("quality") == 0, 0.05, 0.6).count() == 0


def test_empty_tables_and_extra_columns(spark):
    pages, labels = learned(spark)
    assert U.judge(pages.limit(0), labels, F.col("quality") == 0).count() == 0
    extra = pages.withColumns({"host": F.lit(1), "rule": F.lit(2), "tokens": F.lit(3), "doc_id": F.lit(4)})
    assert U.judge(extra, labels.withColumn("page_id", F.lit(1)), F.col("quality") == 0).count() == 125
