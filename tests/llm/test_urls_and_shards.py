"""URL rules and sharding against plain versions."""

import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskline.llm import hash_tree, url_rules
from riskline.llm.queries import URL_RULES

URLS = ["http://www.Example.com/en/a?x=1", "https://example.com/en/", "http://example.com/en", "x://com/", "http://com",
        "http://a.b.net/es/1#f", "net/es/", None, "", "://", "http://EXAMPLE.COM/EN/", "http://notexample.com/en/", "http://example.com./en/",
        "http://ads.www.example.com/en/z", "http://example-x.com/en/", "http://shop.net/fr/?q", "http://x.org/en/", "a://b://net/es/",
        "http://.com/p", "http://user@example.com/en/", "http://example.com:80/en/", "http://net/es/\nline", "http://münchen.net/fr/ü"]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in URL_RULES:
        h, p = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


def test_url_rules_equal_plain(spark):
    rows = [Row(page_id=i, url=u, host="mine", key="k", bucket=1) for i, u in enumerate(URLS * 2)]
    rows += [Row(page_id=None, url=URLS[0], host=None, key=None, bucket=None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string, bucket int")
    got = url_rules.judge_urls(pages, url_rules.rules_table(spark, URL_RULES)).collect()
    want = [(r.page_id, *plain_rule(r.url)) for r in rows]
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_url_rules_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, rule string")
    assert [tuple(r) for r in url_rules.judge_urls(pages, none, otherwise="block").collect()] == [(1, "a.com", "/b", None, "block")]
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_table(spark, URL_RULES)).count() == 0


def test_url_rules_nested_stack(spark):
    rules = [("block", "a.b.c/"), ("allow", "b.c/"), ("block", "c/x/"), ("allow", "z.c/"), ("block", "b.c/x/"), ("allow", "void")]
    pages = spark.createDataFrame([(i, f"h://{h}{p}") for i, (h, p) in enumerate(
        (h, p) for h in ("c", "b.c", "a.b.c", "q.a.b.c", "aa.b.c", "z.c", "y.c", "bb.c", "d") for p in ("/", "/x/1", ""))], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_rules.judge_urls(pages, url_rules.rules_table(spark, rules)).collect()}
    for r in pages.collect():
        host, _, path = r.url[4:].partition("/")
        path = "/" + path if _ else ""
        fit = [x for _, x in rules if "/" in x and (host == x.split("/")[0] or host.endswith("." + x.split("/")[0]))
               and path.startswith("/" + x.split("/", 1)[1])]
        assert got[r.page_id] == max(fit, key=lambda x: (len(x), x), default=None)


def test_shards(spark):
    topology = hash_tree.regular_topology(4, 5, 2)
    rows = [Row(doc_id=i, text=None if i % 50 == 0 else "é" * (i % 7), shard="x", size=1) for i in range(4000)]
    rows += rows[:5] + [Row(doc_id=None, text="n", shard="x", size=1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, size int")
    got = hash_tree.assign_shards(docs, topology, hash_tree.with_new_region(topology)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r.doc_id: r for r in got}
    for r in rows:
        assert by_id[r.doc_id].text_crc32 == zlib.crc32((r.text or "").encode())
        assert by_id[r.doc_id].size == 16 + len((r.text or "").encode())
    moved = sum(r.grown_shard == 40 for r in got) / len(got)
    assert 0.012 < moved < 0.04
    again = hash_tree.assign_shards(docs.repartition(7), topology).select("doc_id", "shard").distinct().collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in got}


def test_weights_move_only_between_changed_subtrees(spark):
    a = [hash_tree.Shard("r0", "k0", 0, 1.0), hash_tree.Shard("r0", "k1", 1, 1.0), hash_tree.Shard("r1", "k0", 2, 2.0), hash_tree.Shard("r1", "k0", 3, 2.0)]
    b = [s._replace(weight=5.0) if s.shard == 1 else s for s in a]
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = hash_tree.assign_shards(docs, a, b).groupBy("shard", "grown_shard").count().collect()
    for r in got:  # from r1 into r0, or into the heavier rack; never inside r1 or out of r0
        assert r.shard == r.grown_shard or r.grown_shard in (0, 1) and not (r.shard == 1 and r.grown_shard == 0)
    share = {k: sum(r["count"] for r in got if r.shard == k) / 4000 for k in range(4)}
    assert abs(share[0] - 1 / 6) < 0.03 and abs(share[2] - 1 / 3) < 0.03


def test_shards_empty_and_wrong(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hash_tree.assign_shards(empty, hash_tree.regular_topology(1, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        hash_tree.assign_shards(empty, [])
