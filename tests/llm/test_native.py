"""Fingerprints, sharding and URL filters against brute force."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fingerprints, sharding, urls
from tests.llm.conftest import words


def test_winnowing_keeps_the_rightmost_minimum_of_each_window(spark):
    texts = ["", "ab", "a" * 300, words(1, 900), "é" * 100 + words(2, 30), words(3, 7) * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(1)
    gram, window = 8, 10
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length("text") - (gram - 1), F.lit(1))), lambda i: F.xxhash64(F.substring(F.col("text").cast("binary"), i, F.lit(gram))))
    for r in df.select("text", fingerprints.winnow(F.col("text"), gram, window).alias("p"), grams.alias("h")).collect():
        h = [x & ~4095 for x in r.h] if r.text else []
        n, want = min(window, len(h)), set()
        for s in range(len(h) - n + 1) if n else []:
            low = min(h[s : s + n])
            want.add(max(i for i in range(s, s + n) if h[i] == low) + 1)
        assert list(r.p) == sorted(want)


def test_shared_runs_share_a_fingerprint(spark):
    run = words(7, 40)
    rows = [(1, words(8, 50) + " " + run + " " + words(9, 50)), (2, "zz " + run)]
    a, b = (set(r.hashes) for r in fingerprints.with_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect())
    assert len(run) >= fingerprints.GRAM + fingerprints.WINDOW and a & b


def test_edits_use_the_next_document(spark, odd, empty):
    got = fingerprints.fingerprint_edits(odd).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want = []
    for r, n in zip(rows, rows[1:] + rows[:1]):
        t, half = r.text or "", len(r.text or "") // 2
        want.append((str(r.doc_id), len(t), hashlib.sha256((t[: len(t) - half] + (n.text or "")[:half]).encode()).hexdigest()))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_next_across_many_buckets(spark):
    n = 3000
    df = spark.range(n).select((F.col("id") * 7919 % 100_003).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = fingerprints.next_in_order(df.select("doc_id", "text"), "doc_id", ["text"], "next").collect()
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    want = {a[0]: b[1] for a, b in zip(rows, rows[1:] + rows[:1])}
    assert len(got) == n and all(r.next.text == want[r.doc_id] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    assert sorted(r.p for r in spark.range(n).select(sharding.shuffled(F.col("id"), n).alias("p")).collect()) == list(range(n))


def test_shards_are_even_and_slots_gapless(spark, odd, empty):
    got = sharding.shard_documents(odd, shards=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == odd.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert want == sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_documents(odd.repartition(3), shards=5).collect()))
    assert sharding.shard_documents(empty).count() == 0


def test_url_rules_and_model(spark):
    cases = {
        "http://a.NET/x?y": ("a.net", "/x", "net/", "block"), "https://m.example.net/en/1": ("m.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.com/de/7#t": ("example.com", "/de/7", "example.com/de/", "block"), "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://notnet/": ("notnet", "/", None, None), "http://net": ("net", "", None, None), None: ("", "", None, None), "no url": ("", "", None, None), "": ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, host int")
    for r, (url, want) in zip(urls.judge_urls(df).orderBy("page_id").collect(), cases.items()):
        assert (r.host, r.path, r.rule) == want[:3], url
        assert r.verdict == want[3] if want[3] else r.verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_url_model_matches_plain_python(spark):
    w, bias = urls.weights()
    pairs = [("www.casino-win.example.org", "/en/5"), ("blog.thenor.example.org", "/en/77.html"), ("", ""), ("ab", "")]
    df = spark.createDataFrame(pairs, "host string, path string").select("host", "path", urls.probability(F.col("host"), F.col("path")).alias("p"))
    for r in df.collect():
        z = bias + sum(w[g] for g in urls._grams(f"{r.host}|{r.path}")) if len(f"^{r.host}|{r.path}$") >= max(urls.GRAMS) else None
        if z is not None:
            assert abs(r.p - 1 / (1 + math.exp(-z))) < 1e-9
    right = sum((1 / (1 + math.exp(-bias - sum(w[g] for g in urls._grams(f"{h}|{p}")))) >= 0.5) == bool(y) for h, p, y in urls.labelled_urls())
    assert right / len(urls.labelled_urls()) > 0.97


def test_url_model_on_held_out_hosts():
    precision, recall, n = urls.measured(0.5)
    assert n == len(urls.labelled_urls()) == 160 and precision >= 0.8 and recall >= 0.75
    assert urls.measured(0.8)[0] >= 0.9
    assert urls.split_url("HTTP://Exa.Org/A?b#c") == ("exa.org", "/A") and urls.split_url("x") == ("", "")


def test_url_training_equals_plain_gradient_descent():
    """The fit against one written out over dense vectors, on a few urls."""
    import numpy as np

    table = urls.labelled_urls()[:6] + urls.labelled_urls()[-6:]
    w, bias = urls.train(table)
    x = np.zeros((len(table), urls.BUCKETS))
    for i, (h, p, _) in enumerate(table):
        x[i, sorted(urls._grams(f"{h}|{p}"))] = 1
    v, b = np.zeros(urls.BUCKETS), 0.0
    order = sorted(range(len(table)), key=lambda i: zlib.crc32(f"{i}:{table[i][0]}".encode()))
    for epoch in range(100):
        for i in order:
            e = table[i][2] - 1 / (1 + np.exp(-b - x[i] @ v))
            rate = 0.1 / (1 + epoch / 20)
            b += rate * 0.02 * e
            v += rate * x[i] * (e - 2e-3 * v)
    assert np.abs(np.array(w) - v).max() < 1e-5 and abs(bias - b) < 1e-5
