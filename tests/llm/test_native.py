"""Sharding, exact dedup and URL rules against plain Python."""
import hashlib
import string
import struct
from collections import Counter, defaultdict
from math import ceil, sqrt

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, numbering, sharding, url_filter
from tidewatch.llm.queries import BAD_HOST_WORDS, URL_RULES
from tidewatch.llm.registry import load

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def spark_hash(*values: int) -> int:
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def feistel(x: int, n: int, seed: int) -> int:
    """The permutation one step at a time."""
    a = max(1, ceil(sqrt(n)))
    b = max(1, ceil(n / a))
    while True:
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            key = seed * 1_000_003 + i
            if i % 2 == 0:
                left = (left + spark_hash(right, key) % a) % a
            else:
                right = (right + spark_hash(left, key) % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), F.lit(n).cast("long"), 5).alias("p"))
    rows = rows.withColumn("back", sharding.permuted(F.col("p"), F.lit(n).cast("long"), 5, backwards=True)).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id and r.p == feistel(r.id, n, 5) for r in rows)


def test_shards(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sharding.shard_rows(docs, 8, 1).collect()
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs.repartition(5, "text"), 8, 1).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in got} == again
    sizes = Counter(r.shard for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(set)
    for r in got:
        slots[r.shard].add(r.slot)
        assert r.position == feistel(r.row_number, len(got), 1) == r.slot * 8 + r.shard
    assert all(s == set(range(len(s))) for s in slots.values())
    odd = sharding.shard_rows(odd_docs, 3, by=["doc_id", "text"])
    assert sorted(r.position for r in odd.collect()) == list(range(odd_docs.count())) and odd.columns.count("slot") == 1


def test_no_rows_to_shard(no_docs):
    assert sharding.shard_rows(no_docs, 8).count() == 0


def test_numbers_in_groups(spark):
    rows = spark.range(500).selectExpr("id", "if(id < 400, null, id % 3) AS g")
    found = defaultdict(list)
    for r in numbering.number_rows(rows, ["id"], ["g"], "k", "n", cells=16).collect():
        found[r.g].append((r.k, r.n))
    assert all(sorted(k for k, _ in v) == list(range(len(v))) and {n for _, n in v} == {len(v)} for v in found.values()) and len(found[None]) == 400


def exact_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(FOLD)].append(r.doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("salts", [1, 4])
def test_exact(odd_docs, salts):
    want = exact_by_hand(odd_docs.collect())
    got = exact_dedup.exact_groups(odd_docs.repartition(3), salts=salts).collect()
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == odd_docs.count()
    assert all(by_digest[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(dict.fromkeys(by_digest, 1)) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_rows_stay_as_they_were(odd_docs, no_docs):
    stays = exact_dedup.exact_dedup(odd_docs)
    assert stays.columns == odd_docs.columns and stays.count() == len(exact_by_hand(odd_docs.collect()))
    assert {r.kept for r in stays.collect()} == {"mine"}
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.exact_groups(no_docs).count() == 0


def url_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:at].translate(FOLD), rest[at:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for rule, verdict in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_urls(spark):
    odd = ["http://A.Example.NET/en/x?y#z", "https://example.net", "ftp://sub.example.com/de/1/2/3/4/5/6", "no scheme/net/", "", None, "://", "x://net/",
           "x://notnet/", "http://ORG/fr/", "http://h?a=/net/", "http://É.org/fr/é", "a://b://c.net/d", "http://l\n.net/\nx"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(odd)], "page_id long, url string, verdict string")
    for frame in (pages, spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")):
        urls = {r.page_id: r.url for r in frame.collect()}
        got = url_filter.judge_urls(frame, URL_RULES, BAD_HOST_WORDS).collect()
        assert len(got) == len(urls)
        for r in got:
            host, path, best = url_by_hand(urls[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, best and best[0])
            assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), URL_RULES, BAD_HOST_WORDS).count() == 0


def test_templates(spark):
    """A labelled branch is rejected, its siblings are not; variable segments and branches alike are merged."""
    rows = [("h", f"/bad/{i}", 1) for i in range(20)] + [("h", f"/good/{i}", 0) for i in range(20)] + [("h", f"/new/{i}", None) for i in range(20)]
    rows += [("g", f"/{c}/x", 1) for c in "abcdef" for _ in range(6)] + [("v", f"/{'p' * (i + 1)}", None) for i in range(80)]
    urls = spark.createDataFrame(rows, "host string, path string, bad int")
    got = {(r.host, r.s0): (r.template, r.purity) for r in url_filter.template_purity(urls).collect()}
    assert got["h", "bad"][1] > 0.9 and got["h", "good"][1] < 0.1 and got["h", "new"] == ("h/new/*", pytest.approx(0.1))
    assert {got["g", c][0] for c in "abcdef"} == {"g/*/x"} and {t for (h, _), (t, _) in got.items() if h == "v"} == {"v/*"}


def test_native_plans_run_no_python(spark):
    for name in ("op1_sharding", "op5_exact_dedup", "op6_url_filter"):
        plan = load()[0][name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
