"""Near duplicates, lines and vectors against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import common, lines, linesketch, minhash, vectors
from quillgraph.operators import components as core_components
from tests.llm import line_recall
from tests.llm.conftest import DOCUMENTS, words


def _components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def _shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCUMENTS)


def test_probminhash_estimates_probability_jaccard():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.concatenate([base[:300], base[:100]]), base[50:350]
    sig = minhash.signatures(np.concatenate([a, b, np.zeros(0, np.uint64)]), np.array([0, len(a), len(a) + len(b), len(a) + len(b)]), 4096)
    wa, wb = ({int(k): int(n) for k, n in zip(*np.unique(x, return_counts=True))} for x in (a, b))
    keys = set(wa) | set(wb)
    jp = sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in keys) for x in keys if x in wa and x in wb)
    assert abs((sig[0] == sig[1]).mean() - jp) < 0.03 and (sig[2] == 0).all()


def test_near_duplicates_equal_brute_force(spark):
    texts = [words(i, 120) for i in range(40)]
    texts += [_edited(texts[i % 8], 100 + i, i % 4 + 1) for i in range(60)] + [texts[3], texts[3].upper() + "!"] + ["one two", "One, two."]
    sets = [_shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = _components(len(texts), links)
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(_documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [(w, w == i) for i, w in enumerate(want)]


def test_large_group_is_compared_in_blocks(spark):
    base = words(1, 146)
    texts = [base] + [_edited(base, i, i % 6) for i in range(1, 400)]
    sets = [_shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = _components(len(texts), links)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(_documents(spark, texts)).collect()}
    assert sum(got[i] == w for i, w in enumerate(want)) >= 0.99 * len(want)
    assert all(w <= got[i] for i, w in enumerate(want))  # nothing is linked that should not be


def test_near_duplicates_of_odd_tables(spark, odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, bytes(r.node)): r for r in got}
    assert all(r.kept for r in got if r.doc_id in (3, 4, 9)) and {r.class_id for r in got if r.doc_id in (1, 2)} == {1} and len(by) == odd.count() - 1
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 1 and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id in (3, 4, 5, 6, 7)").count() == 6
    assert minhash.near_duplicates(empty).count() == minhash.keep_one(empty).count() == 0


def test_edit_distance_bound():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(3)
    for _ in range(1500):
        a = "".join(r.choice("abc ") for _ in range(r.randrange(12)))
        b = list(a)
        for _ in range(r.randrange(4)):
            if b:
                b[r.randrange(len(b))] = r.choice("abcd")
        b = "".join(b) + "c" * r.randrange(3)
        m = r.randrange(7)
        assert linesketch.within(a, b, m) == (distance(a, b) <= m)
        if a and b:
            x, y = sorted((a, b), key=len)
            assert not linesketch._by_words(x, y, m) or distance(a, b) <= m
            assert linesketch._few_edits(x, y, m) == linesketch._bit_parallel(x, y, m) == (distance(a, b) <= m)


def _distance_at_most(a, b, m):
    """Plain dynamic programming, without the code under test."""
    if abs(len(a) - len(b)) > m:
        return False
    p = np.arange(len(b) + 1)
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, x in enumerate(a, 1):
        q = np.minimum(p[1:] + 1, p[:-1] + (y != ord(x)))
        q = np.concatenate([[i], q]) - np.arange(len(b) + 1)
        p = np.minimum.accumulate(q) + np.arange(len(b) + 1)
        if p.min() > m:
            return False
    return p[-1] <= m


def _alike(a, b):
    return _distance_at_most(a, b, int(max(len(a), len(b)) * 0.2 + 1e-9))


def _lines_by_brute_force(docs):
    """Line numbers to remove of each text: all pairs of lines by edit similarity, groups by union-find."""
    occurrences = [(d, n, " ".join(re.findall(r"[^\W_]+", x.lower()))) for d, t in enumerate(docs) for n, x in enumerate(t.split("\n"))]
    occurrences = [o for o in occurrences if o[2]]
    keys = sorted({o[2] for o in occurrences})
    group = _components(len(keys), [(i, j) for i in range(len(keys)) for j in range(i) if _alike(keys[i], keys[j])])
    seen, want = set(), {d: [] for d in range(len(docs))}
    for d, n, w in occurrences:
        g = group[keys.index(w)]
        if g in seen:
            want[d].append(n)
        seen.add(g)
    return want


def test_lines_equal_brute_force(spark):
    base = [words(i, 60) for i in range(12)]
    docs = ["\n".join([base[i % 12], words(100 + i, 30), _edited(base[(i + 1) % 12], i, 1), "short line", f"page {i}"]) for i in range(24)] + ["\n".join(base[:2]), "", "a b c d e\nA, b C D e!"]
    want = _lines_by_brute_force(docs)
    got = {r.doc_id: r.removed for r in lines.line_report(_documents(spark, docs)).collect()}
    assert got == want and any(want.values())
    cleaned = {r.doc_id: r.text for r in lines.without_repeated_lines(_documents(spark, docs)).collect()}
    for d, t in enumerate(docs):
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d])
        assert cleaned.get(d) == (left if not want[d] or left.strip() else None)


def test_documents_with_a_line_left_stay(spark):
    line = words(3, 20)
    docs = [line, f"{line}\n----\n***", f"{line}\n \n\t", f"{line}\n。"]
    kept = {r.doc_id: r.text for r in lines.without_repeated_lines(_documents(spark, docs)).collect()}
    assert kept == {0: line, 1: "----\n***", 3: "。"}


@pytest.mark.parametrize("part, sparse", [(512, 8), (512, -1), (7, -1), (7, 8)])
def test_dense_blocks_equal_brute_force(spark, monkeypatch, part, sparse):
    """Lines far from the first of their block, in blocks compared as pairs, within one task, and part by part."""
    monkeypatch.setattr(lines, "PART", part)
    monkeypatch.setattr(lines, "SPARSE", sparse)
    docs = [_edited(f"{words(1, 20)} {words(50 + g, 10)}", 100 * g + k, 1) for g in range(4) for k in range(9)]
    want = _lines_by_brute_force(docs)
    assert {r.doc_id: r.removed for r in lines.line_report(_documents(spark, docs)).collect()} == want and 0 < sum(not w for w in want.values()) < 12


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(core_components, "SPLIT_EDGES", 0)
    monkeypatch.setattr(core_components, "HOT_SHARE", 0.05)
    r = random.Random(1)
    edges = [(0, i) for i in range(1, 120)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)] + [(119, 500)]
    root = _components(501, edges)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root[n] for n in nodes}


def _met(a, b):
    """Shares of the like pairs (edit similarity 0.8, by plain dynamic programming) that share a block and pass the sketch."""
    made = []
    for texts in (a, b):
        data = "\n".join(texts).encode()
        _, _, has, _, text, begins = linesketch.normal(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        *sketch, of, blocks = linesketch.sketches(text, begins, has)
        found = [set() for _ in texts]
        for i, k in zip(of.tolist(), blocks.tolist()):
            found[i].add(k)
        made.append(((*sketch, np.diff(begins)), found))
    (sa, fa), (sb, fb) = made
    ok = linesketch.near(sa, sb, lines.SIMILARITY, lines.DISTANCE)
    like = [i for i in range(len(a)) if a[i] != b[i] and _alike(a[i], b[i])]
    return len(like), sum(bool(fa[i] & fb[i]) and bool(ok[i]) for i in like) / max(len(like), 1)


@pytest.mark.parametrize("n", [3, 5, 8, 15, 30, 60, 200])
def test_recall_by_length(n):
    """At least 0.9 of the like lines of n words are found: one word replaced, one inserted, a tenth replaced, two letters changed."""
    r = random.Random(n)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.choice([2, 3, 3, 4, 5, 6, 7, 9]))) for _ in range(600)]
    base = [[vocabulary[int(600 * r.random() ** 2)] for _ in range(n)] for _ in range(150)]

    def replaced(w, k):
        w = list(w)
        for i in r.sample(range(len(w)), k):
            w[i] = r.choice(vocabulary)
        return w

    def inserted(w):
        w = list(w)
        w.insert(r.randrange(len(w) + 1), r.choice(vocabulary))
        return w

    def typed(w):
        t = list(" ".join(w))
        for i in r.sample([i for i, c in enumerate(t) if c != " "], 2):
            t[i] = r.choice("xyz")
        return "".join(t).split()

    for kind, edit in (("replaced", lambda w: replaced(w, 1)), ("inserted", inserted), ("tenth", lambda w: replaced(w, max(1, n // 10))), ("letters", typed)):
        like, found = _met([" ".join(w) for w in base], [" ".join(edit(w)) for w in base])
        assert like >= 10 and found >= 0.9, (kind, like, found)


@pytest.mark.parametrize("n", [5, 8, 10, 15, 20, 30, 60, 200])
def test_recall_of_worn_lines(n):
    """At least 0.9 of the like lines of n words are found with a fifth of the words replaced, or a letter in twenty changed."""
    for kind, like, found in line_recall.shares(n, ("a fifth of the words replaced", "a letter in twenty changed"), _met, 150 if n < 60 else 40):
        assert like >= 10 and found >= 0.9, (kind, like, found)


def test_many_edit_distances_at_once():
    r = random.Random(9)
    pairs = []
    for _ in range(900):
        a = "".join(r.choice("abcdefgh é漢") for _ in range(r.choice([1, 9, 63, 64, 65, 128, 150, 200, 900])))
        b = list(a)
        for _ in range(int(len(a) * r.random() * 0.35)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = r.choice(["", "x", "q"])
        b = "".join(b) if r.random() < 0.8 else "".join(r.choice("abcdefgh ") for _ in b)
        pairs.append((a, b, int(max(len(a), len(b)) * 0.2)))
    want = [_distance_at_most(*p) for p in pairs]
    assert linesketch.all_within(pairs) == want and 100 < sum(want) < 800 and linesketch.all_within([]) == []


def test_edit_distance_of_long_lines():
    r = random.Random(5)
    a = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    b = list(a)
    for i in r.sample(range(len(b)), 300):
        b[i] = "x"
    b = "".join(b)
    assert linesketch.within(a, b, 300) and linesketch.within(a, "y" + b, 301) and not linesketch.within(a, b, 250)
    assert not linesketch.within(a, "".join(r.choice("abcdefgh ") for _ in range(20_000)), 4000)


def test_lines_of_odd_tables(spark, odd, empty):
    out = lines.without_repeated_lines(odd)
    assert out.columns == odd.columns and lines.line_report(odd).count() == odd.count()
    assert {r.doc_id for r in out.where("doc_id in (1, 2, 3, 4, 9)").collect()} == {1, 3, 4, 9}
    assert lines.line_report(empty).count() == lines.without_repeated_lines(empty).count() == 0


def _vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, key string, n int")


def _vector_brute(ids, vecs):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    n = len(ids)
    u = [np.array(v, float) / np.linalg.norm(v) if k else None for v, k in zip(vecs, ok)]
    links = [(i, j) for i in range(n) for j in range(i) if ok[i] and ok[j] and float(u[i] @ u[j]) >= 0.95]
    count = [0] * n
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return count, _components(n, links)


@pytest.mark.parametrize("home", [4096, 37])
def test_vectors_equal_brute_force(spark, monkeypatch, home):
    monkeypatch.setattr(vectors, "HOME", home)
    monkeypatch.setattr(vectors, "GROUP", 1)
    r = np.random.default_rng(4)
    centres = r.normal(size=(25, 12))
    vecs = [(centres[i % 25] + 0.25 * r.normal(size=12)).astype("f4").tolist() for i in range(500)] + [r.normal(size=12).astype("f4").tolist() for _ in range(60)]
    vecs += [vecs[0]] * 30 + [[2 * x for x in vecs[1]]]
    vecs += [None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e-30] * 12, [1e30] * 12]
    count, root = _vector_brute(list(range(len(vecs))), vecs)
    got = {x.vec_id: x for x in vectors.near_vectors(_vectors(spark, [(i, v, 0, "k", 1) for i, v in enumerate(vecs)]).repartition(5)).collect()}
    assert [got[i].n_links for i in range(len(vecs))] == count
    assert [got[i].component_id for i in range(len(vecs))] == root
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_cells_rule_out_pairs_of_clustered_vectors():
    """Several cells whatever the number of cores, and most pairs of far clusters are never compared."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 16))
    u = np.concatenate([c + 0.02 * r.normal(size=(50, 16)) for c in centres])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = len(u)
    assert [vectors._pivots(k) for k in (1000, 4000, 16000)] == [16, 32, 64]
    pivots = u[r.permutation(n)[: vectors._pivots(n)]]
    angles = vectors._angles(u, pivots)
    home = angles.argmin(1)
    radius, counts = np.zeros(len(pivots)), np.bincount(home, minlength=len(pivots))
    np.maximum.at(radius, home, angles.min(1))
    reach = float(np.arccos(0.95))
    may = vectors._possible(angles, radius, reach)
    assert (may @ counts).sum() < 0.5 * n * n
    for i in range(0, n, 97):
        assert may[i, home[u @ u[i] >= 0.95]].all()
    first, parts = vectors._groups(counts, 300)
    held = np.bincount(first, weights=np.where(parts == 1, counts, 0))
    assert held.max() <= 300 and len(np.unique(first)) > 4 and (np.diff(first) >= 0).all()


def test_vectors_of_odd_tables(spark):
    assert vectors.near_vectors(_vectors(spark, [])).count() == 0
    assert vectors.near_vectors(_vectors(spark, [(1, None, 0, "k", 1)])).collect()[0].n_links == 0
    rows = [(1, [1.0, 0.0], 0, "k", 1), (1, [1.0, 0.0], 0, "k", 1), (None, [2.0, 0.01], 0, "k", 1), (2, [0.0, 1.0], 0, "k", 1)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in vectors.near_vectors(_vectors(spark, rows, "double")).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 0, 2), ("None", 2, 1)]
    assert F is not None


def test_near_lines_of_every_length_are_found(spark):
    docs, want = [], 0
    for n in (5, 6, 8, 12, 20, 30):
        for i in range(20):
            base = words(1000 * n + i, n)
            copy = _edited(base, i, 1)
            docs += [base, copy]
            want += _alike(base, copy)
    removed = {r.doc_id: r.removed for r in lines.line_report(_documents(spark, docs)).collect()}
    assert want > 80 and sum(bool(removed[i]) for i in range(1, len(docs), 2)) >= 0.95 * want
    assert not any(removed[i] for i in range(0, len(docs), 2))


def test_short_and_unspaced_lines(spark):
    long = "これは句読点のない長い一行であり空白がどこにもないので一語とされていた"
    docs = ["Contents\n---\nfirst", "contents!\n***\nsecond", "\n---\nthird", long, long[:10] + "々" + long[11:], "全角　空白", "全角 空白"]
    removed = {r.doc_id: r.removed for r in lines.line_report(_documents(spark, docs)).collect()}
    assert removed == {0: [], 1: [0], 2: [1], 3: [], 4: [0], 5: [], 6: [0]}


def test_sketch_finds_texts_that_differ_in_repeats_only():
    import pyarrow as pa

    texts = []
    for i in range(30):
        w = words(500 + i, 200).split()
        texts += [" ".join(w), " ".join(w + w[:60] * 12)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "node": [b""] * 60, "text": texts})
    bands = [set(x) for b in minhash._sketch(5, 24, 6)(iter([batch])) for x in b.column("bands").to_pylist()]
    assert all(bands[i] & bands[i + 1] for i in range(0, 60, 2))


def test_copies_without_doc_id(spark):
    base, other = words(900, 120), words(901, 120)
    rows = [(1, base), (None, base), (None, _edited(base, 1, 1)), (None, other), (None, _edited(other, 2, 1)), (2, _edited(other, 3, 1))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCUMENTS)
    assert sorted(r.doc_id or 0 for r in minhash.keep_one(docs).collect()) == [1, 2]
    assert sum(len(r.removed) for r in lines.line_report(docs).collect()) == 4


def test_tasks_of_lines_make_no_rows_for_pairs():
    import pyarrow as pa

    n = 12
    batch = pa.RecordBatch.from_pydict({"task": [1] * n, "near": [1] * n, "id": list(range(n)), "part": [0] * n, "root": [bytes([i]) for i in range(n)], "sim": [7] * n, "more": [7] * n, "size": [100] * n})
    assert sum(b.num_rows for b in lines._like(0.8, 52)(iter([batch]))) == n


def test_blocks_dealt_in_bytes_meet_as_rows_do():
    import pyarrow as pa

    r = random.Random(4)
    rows = [(i, [r.randrange(300) << 32 | r.randrange(3) for _ in range(r.randrange(6))]) for i in range(400)] + [(7, [5, 5])]
    rows = [(i, [b & lines.BLOCK_BITS for b in blocks]) for i, blocks in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.list_(pa.int64()))], ["id", "blocks"])
    dealt = [x for b in lines._dealt(5)(iter([batch])) for x in b.to_pylist()]
    got = set()
    for p in range(5):
        part = pa.RecordBatch.from_pylist([x for x in dealt if x["part"] == p], pa.schema([("part", pa.int32()), ("blocks", pa.binary()), ("ids", pa.binary())]))
        got |= {tuple(x.values()) for b in lines._meet()(iter([part])) for x in b.to_pylist()}
    members = {}
    for i, blocks in rows:
        for b in blocks:
            members.setdefault(b, set()).add(i)
    assert got == {(b, i, min(m), len(m)) for b, m in members.items() if len(m) > 1 for i in m} and got


def test_shuffle_files_go_with_the_frame_that_made_them(spark):
    import time

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    for _ in range(3):
        common.materialize(spark.range(1000).repartition(5, "id"), "own").count()
    end = time.time() + 20
    before = files()
    common.materialize(spark.range(1000).repartition(40, "id"), "own")
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_unlike_lines_are_left_early(monkeypatch):
    """Many pairs go through the recurrence together, without a look at the words of each."""
    called = []
    monkeypatch.setattr(linesketch, "_by_words", lambda *_: called.append(1) or False)
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    pairs = [(text(300), text(310), 62) for _ in range(200)]
    same = text(305)
    assert linesketch.all_within([*pairs, (same, same[:100] + "zz" + same[103:], 61)]) == [False] * 200 + [True]
    assert len(called) <= 1


def test_alike_members_of_tasks_in_any_batches():
    import pyarrow as pa

    r = random.Random(6)
    rows = [{"task": k, "near": k, "id": r.randrange(99), "part": r.randrange(2), "root": bytes([r.randrange(4)]), "sim": r.choice([0, 7, -1]), "more": 0, "size": r.choice([100, 110, 140])} for k in range(40) for _ in range(r.randrange(1, 9))]
    want = []
    for k in range(40):
        mine = [x for x in rows if x["task"] == k]
        ok = lines._possible([tuple(x.values())[2:] for x in mine], 0.8, 52) if len(mine) > 1 else np.zeros((1, 1), bool)
        want += [mine[i] for i in np.flatnonzero(ok.any(0) | ok.any(1))]
    for n in (3, 50, len(rows)):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + n]) for i in range(0, len(rows), n)]
        got = [x for b in lines._like(0.8, 52)(iter(batches)) for x in b.to_pylist()]
        assert got == [{c: x[c] for c in ["task", *lines._ROW, "near"]} for x in want] and got


def test_recall_of_lines_without_long_words():
    """Tables of digits, numbers and letters, rules, and the same few words or characters again and again."""
    r = random.Random(5)
    row = lambda n, pick: " ".join(str(pick()) for _ in range(n))
    kinds = {
        "digits": lambda: row(60, lambda: r.randrange(10)), "numbers": lambda: row(40, lambda: r.randrange(1000)), "letters": lambda: row(50, lambda: r.choice("abcdefghijklmnopqrstuvwxyz")),
        "rules": lambda: r.choice("-=*_") * r.randint(10, 90), "spaced rules": lambda: " ".join(r.choice("-=*_") * r.randint(10, 90)), "a word": lambda: " ".join([r.choice(["ha", "alpha"])] * r.randint(14, 40)),
        "a character": lambda: r.choice("ab") * r.randint(30, 120),
    }

    def changed(t):
        i = r.choice([i for i, c in enumerate(t) if c != " "])
        return t[:i] + (r.choice("0123456789") if t[i].isalnum() else r.choice("+~")) + t[i + 1 :]

    for kind, make in kinds.items():
        for edit in (changed, lambda t: t + t[-max(1, len(t) // 12) :]):
            base = [make() for _ in range(100)]
            like, found = _met(base, [edit(t) for t in base])
            assert like >= 10 and found >= 0.9, (kind, like, found)


def test_lines_without_long_words_are_found(spark):
    table = "1 0 2 7 7 4 1 9 0 3 5 2 2 8 1 0 6 4 3 3 9 1 0 5 7 2 8 6 4 1 1 0 3"
    docs = ["=" * 70, table, " ".join(["ha"] * 30), "=" * 78, table[:20] + "9" + table[21:], " ".join(["ha"] * 33)]
    assert {r.doc_id: r.removed for r in lines.line_report(_documents(spark, docs)).collect()} == {0: [], 1: [], 2: [], 3: [0], 4: [0], 5: [0]}
