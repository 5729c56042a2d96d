"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bytewords
from quillgraph.llm.common import map_batches, materialize

#: Labelled documents fitted on at most, those of the smallest hashes. Everything else runs over all rows.
TRAIN_ROWS = 8_000

#: The learned lexicon: word starts of so many bytes (and whole words), how many toxic documents must have an entry, how
#: much more frequent it must be in toxic text, and how many entries are kept.
STARTS = (5, 6, 7, 8)
SUPPORT, RATIO, ENTRIES = 3, 6.0, 600

#: Insults (in lower case) by language; the densities of these words are features.
LEXICON = {
    "en": "idiot idiots moron morons stupid dumb trash scum loser losers clown clowns pathetic worthless disgusting filth filthy vermin imbecile jerk creep coward liar fool foolish ugly garbage crap damn hell bastard bitch shit shitty fuck fucking asshole dickhead cunt whore slut retard retarded psycho freak pig rat swine parasite degenerate",
    "fr": "idiote crétin crétins imbécile imbéciles connard connards salaud ordure merde putain abruti débile pauvre minable raclure",
    "de": "idioten dummkopf trottel arschloch scheiße abschaum versager blöd hurensohn schwachkopf wichser drecksack",
    "es": "idiotas imbécil estúpido estúpida basura escoria mierda cabrón gilipollas puta perdedor inútil asqueroso payaso",
}
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre vos ton du dich dir dein deine ihr euch usted tú ti vuestro"

#: What stands for letters in disguised words (fixed values): digits and signs that look like them.
_DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
NEAR = 5  # words

_b = np.arange(256)
_plain = bytewords.LOWER.copy()
for _k, _v in _DISGUISES.items():
    _plain[ord(_k)] = ord(_v)
_LETTER = ((bytewords.LOWER >= 97) & (bytewords.LOWER <= 122)) | (_b >= 128)
_DIGIT = (_b >= 48) & (_b <= 57)
_UPPER = (_b >= 65) & (_b <= 90)
_INNER = np.isin(_b, [ord(c) for c in "@$!*#"])  # may stand inside a disguised word
_PUNCT = np.isin(_b, [ord(c) for c in "!?"])
_MARK = ~(_LETTER | _DIGIT | ~bytewords.SOLID)
_DISGUISED = _LETTER | _DIGIT | _INNER

FEATURES = ("lexicon", "lexicon_count", "disguised", "near_you", "you", "capitals", "shouts", "marks", "obfuscated", "words", "mean_length", "learned", "learned_count")


def _hashes(words: str) -> np.ndarray:
    data = [w.encode() for w in words.split()]
    flat = np.frombuffer(b"".join(data), np.uint8)
    end = np.cumsum([len(w) for w in data])
    return np.sort(bytewords.hash_spans(flat, end - np.array([len(w) for w in data]), end))


_LEX = _hashes(" ".join(LEXICON.values()))
_YOU = _hashes(SECOND_PERSON)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _near(hits: np.ndarray, begins: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which hits have a mark within NEAR words in the same text."""
    c = np.concatenate([[0], np.cumsum(marks)])
    of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    i = np.arange(len(hits))
    lo, hi = np.maximum(i - NEAR, begins[:-1][of]), np.minimum(i + NEAR + 1, begins[1:][of])
    return hits & (c[hi] > c[lo])


def _entries(low: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its starts (a shorter word stands for its start)."""
    return [hashes, *(bytewords.hash_spans(low, start, np.minimum(start + k, end)) for k in STARTS)]


def features(column: pa.Array, learned: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features) for runs of whole texts, with a learned lexicon of sorted hashes; null and empty texts have zeros."""

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=c[1:])
        return (c[at[1:]] - c[at[:-1]]).astype(np.float64)

    for row, _, data, offsets in bytewords.slices(column):
        low = bytewords.LOWER[data]
        start, end, begins = bytewords.words(data, offsets)
        hashes = bytewords.hash_spans(low, start, end)
        n = np.maximum(np.diff(begins), 1).astype(np.float64)
        size = np.maximum(np.diff(offsets), 1).astype(np.float64)
        hit, you = _among(hashes, _LEX), _among(hashes, _YOU)
        taught = np.zeros(len(hashes), bool)
        if len(learned):
            for e in _entries(low, start, end, hashes):
                taught |= _among(e, learned)
        letters = np.maximum(total(_LETTER[data], offsets), 1)
        # words in which letters are mixed with digits or signs, read with those replaced
        ds, de, db = bytewords.words(data, offsets, _DISGUISED)
        mixed = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~_LETTER[data], out=mixed[1:])
        signs = mixed[de - 1] > mixed[ds] if len(ds) else np.zeros(0, bool)
        odd = signs & _LETTER[data[ds]] if len(ds) else signs
        masked = odd & _among(bytewords.hash_spans(_plain[data], ds, de), _LEX) if len(ds) else odd
        f = np.stack(
            [
                100 * total(hit, begins) / n, np.log1p(total(hit, begins)), 100 * total(masked, db) / n, 100 * total(_near(hit | taught, begins, you), begins) / n, 100 * total(you, begins) / n,
                total(_UPPER[data], offsets) / letters, 100 * total(_PUNCT[data], offsets) / size, total(_MARK[data], offsets) / size, 100 * total(odd, db) / n, np.log1p(n), letters / n,
                100 * total(taught, begins) / n, np.log1p(total(taught, begins)),
            ],
            axis=1,
        )
        f[np.diff(begins) == 0] = 0
        yield row, f


class Boosted:
    """Gradient-boosted regression trees for log-odds, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 5, l2: float = 2.0):
        self.cuts = [np.unique(np.quantile(c[c > c.min()] if (c > c.min()).any() else c, np.linspace(0, 1, bins)[:-1])) for c in x.T]
        codes = self._codes(x)
        width = max(len(c) for c in self.cuts) + 1
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees, self.depth, self.rate = float(np.log(p / (1 - p))), [], depth, rate
        z = np.full(len(y), self.base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(len(y), np.int64)
            split = []
            for level in range(depth):
                n, best = 1 << level, np.full(1 << level, 1e-9)
                choice = np.zeros((n, 2), np.int64)
                choice[:, 1] = width  # no split: all go left
                for k in range(codes.shape[1]):
                    at = node * width + codes[:, k]
                    G, H, N = (np.cumsum(np.bincount(at, w, n * width).reshape(n, width), axis=1) for w in (g, h, None))
                    gt, ht, nt = G[:, -1:], H[:, -1:], N[:, -1:]
                    gain = G**2 / (H + l2) + (gt - G) ** 2 / (ht - H + l2) - gt**2 / (ht + l2)
                    gain[(N < least) | (nt - N < least)] = -np.inf
                    i = gain.argmax(1)
                    value = gain[np.arange(n), i]
                    better = value > best
                    best[better], choice[better, 0], choice[better, 1] = value[better], k, i[better]
                split.append(choice)
                node = node * 2 + (codes[np.arange(len(y)), choice[node, 0]] > choice[node, 1])
            leaves = 1 << depth
            value = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
            self.trees.append((split, value))
            z += rate * value[node]

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        codes, z = self._codes(x), np.full(len(x), self.base)
        for split, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for choice in split:
                node = node * 2 + (codes[np.arange(len(x)), choice[node, 0]] > choice[node, 1])
            z += self.rate * value[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function (thresholds, values) nearest to y, by pooling adjacent violators; each block is
    drawn a little towards the mean so that no score is beyond doubt."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order].astype(float)
    blocks: list[list[float]] = []
    for t, v in zip(z, y, strict=True):
        if blocks and blocks[-1][0] == t:
            blocks[-1][1] += v
            blocks[-1][2] += 1
        else:
            blocks.append([t, v, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    mean = y.mean()
    return np.array([b[0] for b in blocks]), np.array([(b[1] + mean) / (b[2] + 1) for b in blocks])


class Model:
    """Trees on all labelled rows, calibrated on what trees of one half say of the other half."""

    def __init__(self, x: np.ndarray, y: np.ndarray, half: np.ndarray, learned: np.ndarray):
        self.constant, self.learned = None, learned
        if len(y) < 40 or len(set(y[half])) < 2 or len(set(y[~half])) < 2:
            self.constant = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
            return
        z = np.zeros(len(y))
        for side in (half, ~half):
            z[~side] = Boosted(x[side], y[side])(x[~side])
        self.trees = Boosted(x, y)
        self.at, self.value = isotonic(z, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.trees(x)
        # steps with a slight slope within them keep the ranking of the trees
        step = self.value[np.maximum(np.searchsorted(self.at, z, "right") - 1, 0)]
        return np.clip(step + 1e-4 * (1 / (1 + np.exp(-z)) - 0.5), 0.0, 1.0)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores) for runs of whole texts."""
        for row, f in features(column, self.learned):
            yield row, self.score(f)


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _fold(ids: pa.Array) -> np.ndarray:
    return (bytewords.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(40)).astype(np.int64) & 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By fold and lexicon entry: words and documents of either label; entry 0 counts all words."""
    for b in batches:
        fold, y = _fold(b.column("doc_id")), b.column("y").to_numpy()
        for row, to, data, offsets in bytewords.slices(b.column("text")):
            low = bytewords.LOWER[data]
            start, end, begins = bytewords.words(data, offsets)
            of = np.repeat(np.arange(row, to), np.diff(begins))
            hashes = bytewords.hash_spans(low, start, end)
            found = np.concatenate([np.stack([np.repeat(np.uint64(0), len(of)), of.astype(np.uint64)], 1), *(np.stack([e, of.astype(np.uint64)], 1) for e in _entries(low, start, end, hashes))])
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]).any(1)
            at = np.flatnonzero(new)
            words = np.diff(np.append(at, len(found)))
            entry, doc = found[at, 0], found[at, 1].astype(np.int64)
            group = np.stack([entry, (fold[doc] * 2 + y[doc]).astype(np.uint64)], 1)
            order = np.lexsort((group[:, 1], group[:, 0]))
            group, words = group[order], words[order]
            new = np.ones(len(group), bool)
            new[1:] = (group[1:] != group[:-1]).any(1)
            at = np.flatnonzero(new)
            if len(at):
                n, d = np.add.reduceat(words, at), np.diff(np.append(at, len(group)))
                yield pa.RecordBatch.from_arrays([pa.array(group[at, 0].astype(np.int64)), pa.array(group[at, 1].astype(np.int32)), pa.array(n), pa.array(d)], ["entry", "side", "words", "docs"])


def _lexicons(train: DataFrame) -> list[np.ndarray]:
    """Learned lexicons from fold 0, fold 1 and both: entries that are much more frequent in toxic text."""
    side = lambda k, c: F.sum(F.when(F.col("side") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counts = map_batches(train, _word_counts, "entry long, side int, words long, docs long").groupBy("entry").agg(*(side(k, c) for k in range(4) for c in ("words", "docs")))
    counts = materialize(counts.where((F.col("docs1") + F.col("docs3") >= SUPPORT) | (F.col("entry") == 0)), "entries")
    all_ = counts.where("entry = 0").first()
    out = []
    for folds in ((0,), (1,), (0, 1)):
        add = lambda c, y: sum((F.col(f"{c}{2 * f + y}") for f in folds), F.lit(0))  # noqa: B023, E731
        total = [max(1, sum(all_[f"words{2 * f + y}"] for f in folds)) if all_ else 1 for y in (0, 1)]
        ratio = ((add("words", 1) + 0.5) / total[1]) / ((add("words", 0) + 0.5) / total[0])
        kept = counts.where("entry <> 0").select("entry", ratio.alias("ratio"), add("docs", 1).alias("docs")).where((F.col("docs") >= SUPPORT) & (F.col("ratio") >= RATIO))
        got = kept.orderBy(F.desc(F.log("ratio") * F.sqrt("docs")), "entry").limit(ENTRIES).collect()
        out.append(np.sort(np.array([r["entry"] for r in got], np.int64).view(np.uint64)))
    return out


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled documents that are not held out: at most `rows` of them, those of the smallest hashes.

    The learned lexicon is counted on the executors; to be fitted on honest densities, each fold's features use the lexicon
    of the other fold. The driver gets at most ENTRIES entries and one row of features for each label; of texts that share a
    labelled doc_id, the first in order counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    train = documents.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    train = materialize(train.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "train")  # one row for each labelled id
    lexicons = _lexicons(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = _fold(b.column("doc_id"))
            one, other = (np.concatenate([f for _, f in features(b.column("text"), lexicons[k])]) for k in (1, 0))
            f = np.where((fold == 0)[:, None], one, other)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(f), pa.list_(pa.float64()))], ["doc_id", "y", "f"])

    got = map_batches(train, run, "doc_id long, y int, f array<double>").orderBy("doc_id", "f").collect()
    x = np.array([r["f"] for r in got], float).reshape(-1, len(FEATURES))
    ids = np.array([r["doc_id"] for r in got], np.int64)
    half = bytewords.mix(ids.view(np.uint64)) % np.uint64(2) == 0
    return Model(x, np.array([r["y"] for r in got], float), half, lexicons[2])


def score_documents(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (1 if score >= 0.5) of every whole text.

    Only texts are inputs of a score. Null and empty texts have features of zero and get the score of a text without any
    signal. Without enough labels of both kinds every score is the share of label 1. Repeated rows score alike, further columns
    are not looked at, and an empty table gives no rows.
    """
    model = fit(documents, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, score in model(b.column("text")):
                n = len(score)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, n), b.column("held_out").slice(row, n), pa.array(score)], ["doc_id", "held_out", "score"])

    scored = map_batches(documents.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, least: float = 0.5) -> DataFrame:
    """documents without those that score at least `least`; all columns as they were. Scoring runs inside one pass, so that
    no text is shuffled. Null and empty texts have no signal and stay (unless that scores `least` too), repeated rows are
    judged alike, and an empty table stays empty."""
    model = fit(documents, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, score in model(b.column("text")):
                kept = b.slice(row, len(score)).filter(pa.array(score < least))
                if kept.num_rows:
                    yield kept

    return map_batches(documents, run, documents.schema)
