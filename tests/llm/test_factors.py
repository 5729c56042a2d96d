"""Passages that repeat, against a plain search of all windows."""

import random
import re

from quillgraph.llm import factors
from tests.llm.conftest import words

DOCS = "doc_id long, text string, place long, text_id long, seed long, source string"


def _plain(rows):
    last = 2**63 - 1
    cut = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    low = {}
    for d, w in cut:
        o = last if d is None else d
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            low[k] = min(low.get(k, last), o)
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if low[tuple(w[i : i + 13])] < (last if d is None else d):
                gone[i : i + 13] = [True] * 13
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def _tables(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, "s") for d, t in rows], DOCS).repartition(3)


def test_passages_equal_all_windows(spark):
    """Passages of 12 to 40 words, of exactly 13, that abut or overlap, in many documents; near and exact copies; repeated phrases;
    one doc_id on several texts; rows without doc_id; a very long text."""
    r = random.Random(5)
    shared = [words(900 + i, n) for i, n in enumerate([12, 13, 14, 20, 40])]
    rows = []
    for d in range(60):
        parts = [words(d, r.randrange(0, 40)), r.choice(shared), words(100 + d, r.choice([0, 1, 30])), r.choice(shared), words(200 + d, r.randrange(0, 20))]
        rows.append((r.choice([d, d, d, None, d // 2]), r.choice([" ", "\n", "\t \r"]).join(parts)))
    base = words(7, 300).split(" ")
    for d in range(100, 112):
        copy = list(base)
        copy[r.randrange(300)] = "éé"
        rows.append((d, " ".join(copy)))
    rows += [(200, "a b " * 40), (201, "b a " * 30 + "c"), (202, "a b " * 40), (203, "a b " * 40), (203, "a b " * 40), (204, " ".join(shared)), (205, words(3, 30_000)), (206, " " + words(3, 30_000)), (207, None), (208, " \n "), (209, "x" * 5000)]
    found = factors.without_repeated_passages(_tables(spark, rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found))) == sorted(map(str, _plain(rows)))
    texts = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows if d is not None and d >= 100}
    for x in found:  # each factor stands in its source, which is earlier
        for f in x.factors:
            assert f.length >= 13 and (x.doc_id is None or f.source < x.doc_id)
            if x.doc_id in texts and f.source in texts and x.doc_id != 203:
                part, whole = " ".join(texts[x.doc_id][f.start : f.start + f.length]), " ".join(texts[f.source])
                assert part in whole or f.start == 0


def test_passages_of_odd_tables(spark, odd, empty):
    assert factors.passage_digests(odd).count() == odd.count() and factors.passage_digests(empty).count() == 0
