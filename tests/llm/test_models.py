"""Toxicity, mixing and the pipeline."""

import random
import re

import pytest

import corpus_pipeline
from quillgraph.llm import mixing, toxicity
from tests.llm.conftest import DOCUMENTS, words

INSULTS = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def labelled(spark):
    r, rows, labels = random.Random(1), [], []
    for i in range(900):
        w, toxic = words(i, 60).split(), i % 5 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(INSULTS if i % 2 else ["grumble77", "grumbly33"])
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = toxicity.score_documents(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and 100 < len(held) < 260 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    left = toxicity.reject_toxic(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id % 5 <> 0").count() >= 710


def test_toxicity_ignores_held_out_labels(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - labels.toxic).otherwise(labels.toxic))
    key = lambda l: sorted((r.doc_id, r.score) for r in toxicity.score_documents(docs, l).collect())  # noqa: E731, E741
    assert key(labels) == key(flipped)


def test_toxicity_of_odd_tables(spark, labelled, odd, empty):
    _, labels = labelled
    assert toxicity.score_documents(odd, labels).count() == odd.count()
    assert toxicity.score_documents(empty, labels).count() == 0
    none = toxicity.score_documents(odd, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.reject_toxic(odd, labels).columns == odd.columns


def test_isotonic_is_monotone():
    import numpy as np

    r = np.random.default_rng(0)
    z = r.normal(size=400)
    at, value = toxicity.isotonic(z, (r.random(400) < 1 / (1 + np.exp(-2 * z))).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= -0.02).all()


def test_targets_fill_up_to_the_caps():
    sizes = {"a": 10, "b": 500, None: 90, "c": 400}
    t = mixing.targets(sizes)
    assert t["a"] == 30 and abs(sum(t.values()) - 1000) < 1e-6 and abs(t["b"] / t["c"] - 2) < 1e-9 and abs(t[None] - min(270, 5 * t["c"])) < 1e-6
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


@pytest.mark.parametrize("chunk", [4096, 50])
def test_mix_is_balanced_and_reproducible(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    r = random.Random(2)
    rows = [(i, words(i, r.choice([1, 5, 20, 60, 200])), "en", r.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 1500 and all(x.taken == x["size"] * x.copies and x.copies <= 3 for x in got)
    for s in ("a", "b", "c", None):
        part = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in part) - part[0].target) <= 100 and part[0].source_size == sum(x["size"] for x in part)
        ratio = part[0].target / part[0].source_size
        assert abs(sum(x.copies for x in part) - ratio * len(part)) <= 0.06 * len(part) + 8
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))


def test_mix_of_clashing_ids_agrees_on_reruns(spark):
    """Null and repeated doc_ids, texts that repeat, and fully equal rows: each row gets the same copies in any order and partitioning."""
    r = random.Random(3)
    rows = [(i % 150 if i % 3 else None, " ".join(["w"] * r.randrange(1, 60)) + f" {i % 90}", "en", "abc"[i % 3 if i % 5 else 0], 1) for i in range(600)] + [(7, "same text here", "en", "b", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = sorted(map(str, mixing.mix_sources(docs, keys=True).collect()))
    for order in (1, 2):
        r.shuffle(rows)
        again = spark.createDataFrame(rows, docs.schema).repartition(3 * order)
        assert sorted(map(str, mixing.mix_sources(again, keys=True).collect())) == one
    taken = sorted(map(str, mixing.mix_documents(docs).collect()))
    assert taken == sorted(map(str, mixing.mix_documents(again).collect()))


def test_mix_of_odd_tables(spark, odd, empty):
    got = mixing.mix_sources(odd).collect()
    want = sorted((str(r.doc_id), len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r["size"]) for r in got) == want
    out = mixing.mix_documents(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(empty).count() == mixing.mix_documents(empty).count() == 0


def test_pipeline_stages(spark, tmp_path, labelled):
    docs, labels = labelled
    near = docs.where("doc_id < 40").selectExpr("doc_id + 5000 AS doc_id", "concat('x ', text) AS text", "lang", "source", "n_chars")
    docs.unionByName(near).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe_encoding"]
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = frame.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and not {r.doc_id for r in out} & set(range(5001, 5040)) and all(r.n_tokens == len(r.ids) for r in out)


def _stump_gain(g, h, left, l2=2.0):
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + l2)


def test_first_split_is_the_best_of_all():
    """The first split of the first tree against every split of every feature, and the scores against walks through the trees."""
    import numpy as np

    r = np.random.default_rng(2)
    x = r.integers(0, 9, (300, 5)).astype(float)
    y = ((x[:, 2] > 4) ^ (r.random(300) < 0.1)).astype(float)
    model = toxicity.Boosted(x, y)
    q = np.full(300, min(max(y.mean(), 1e-3), 1 - 1e-3))
    g, h = y - q, q * (1 - q)
    best = max(_stump_gain(g, h, x[:, k] <= c) for k in range(5) for c in range(9) if 5 <= (x[:, k] <= c).sum() <= 295)
    (k, at), codes = model.trees[0][0][0][0], model._codes(x)
    assert abs(_stump_gain(g, h, codes[:, k] <= at) - best) < 1e-9 and k == 2

    def walk(row):
        z = model.base
        for split, value in model.trees:
            node = 0
            for choice in split:
                k, at = choice[node]
                node = 2 * node + int(np.searchsorted(model.cuts[k], row[k], "left") > at)
            z += model.rate * value[node]
        return z

    assert np.allclose(model(x[:40]), [walk(row) for row in x[:40]])


def test_features_by_plain_python():
    """Each feature of ASCII texts, counted word by word and character by character."""
    import numpy as np
    import pyarrow as pa

    lexicon, second = {w for ws in toxicity.LEXICON.values() for w in ws.split()}, set(toxicity.SECOND_PERSON.split())
    learned = toxicity._hashes("grumble nothing")
    texts = ["You IDIOT!!! read this, you fool. Nothing else here at all...", "An 1d1ot and a sh!t text; grumble grumble, yes?", "plain words only", "", "a1b2 idiot " + "far " * 9 + "you"]
    (_, got), = toxicity.features(pa.array(texts), learned)
    for text, f in zip(texts, got):
        words = re.findall(r"[a-z0-9]+", text.lower())
        n, hit, you = len(words), [w in lexicon for w in words], [w in second for w in words]
        taught = [w in ("grumble", "nothing") for w in words]
        runs = re.findall(r"[A-Za-z0-9@$!*#]+", text)
        odd = [w for w in runs if w[0].isalpha() and any(not c.isalpha() for c in w[:-1])]
        plain = lambda w: "".join(toxicity._DISGUISES.get(c, c) for c in w.lower())
        near = sum((hit[i] or taught[i]) and any(you[max(0, i - 5) : i + 6]) for i in range(n))
        letters, size = max(1, sum(c.isalpha() for c in text)), max(1, len(text))
        want = dict.fromkeys(toxicity.FEATURES, 0.0) if not n else {
            "lexicon": 100 * sum(hit) / n, "lexicon_count": np.log1p(sum(hit)), "disguised": 100 * sum(plain(w) in lexicon for w in odd) / n, "near_you": 100 * near / n, "you": 100 * sum(you) / n,
            "capitals": sum(c.isupper() for c in text) / letters, "shouts": 100 * sum(c in "!?" for c in text) / size, "marks": sum(not c.isalnum() and not c.isspace() for c in text) / size,
            "obfuscated": 100 * len(odd) / n, "words": np.log1p(n), "mean_length": letters / n, "learned": 100 * sum(taught) / n, "learned_count": np.log1p(sum(taught)),
        }
        assert np.allclose(f, [want[k] for k in toxicity.FEATURES]), (text, dict(zip(toxicity.FEATURES, f)), want)


def test_repeated_labelled_ids_count_once(spark, labelled):
    docs, labels = labelled
    again = docs.unionByName(docs.where("doc_id < 50").withColumn("text", toxicity.F.concat(toxicity.F.lit("zz "), "text")))
    one, two = ({r.doc_id: r.score for r in toxicity.score_documents(d, labels).where("doc_id >= 50").collect()} for d in (docs, again))
    assert one == two


def test_pipeline_of_odd_and_empty_tables(spark, labelled, odd, empty):
    _, labels = labelled
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, None)
            assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, None)
        assert out.count() == docs.count()


def test_flight_against_a_plain_cube():
    """Each move of the flight lies in the null space that SVD gives, totals stay as they are until the landing, and over many
    runs a unit's mean is its probability."""
    import numpy as np

    r = np.random.default_rng(6)
    sizes, p = r.integers(1, 500, 40), r.uniform(0.05, 0.95, 40)
    moves = []

    class Watched(mixing._Flight):
        def _move(self, direction):
            before = [(u[0], u[1]) for u in self.units]
            super()._move(direction)
            moves.append((before, [u[1] for u in self.units]))

    taken = np.zeros(40)
    runs = 400
    for seed in range(runs):
        flight, done = Watched(), []
        for i in range(40):
            done += flight.add([int(sizes[i]), float(p[i]), (seed * 40 + i) * 7919 + 1, i])
        assert {u[1] for u in done} <= {0.0, 1.0} and len(flight.units) <= 2
        every = done + flight.units
        assert abs(sum(u[0] * u[1] for u in every) - sizes @ p) < 1e-5 and abs(sum(u[1] for u in every) - p.sum()) < 1e-6
        for u in every:  # before the landing, which chooses the nearest totals, not at random
            taken[u[3]] += u[1]
        assert all(u[1] in (0.0, 1.0) for u in flight.land([]))
    for before, after in moves[:500]:
        a = np.array([[b[0] for b in before], [1.0] * len(before)])
        null = np.linalg.svd(a)[2][np.linalg.matrix_rank(a) :]
        step = np.array(after) - np.array([b[1] for b in before])
        assert np.allclose(null.T @ (null @ step), step, atol=1e-7) and any(min(x, 1 - x) < 1e-9 for x in after)
    assert np.abs(taken / runs - p).max() < 0.11
