"""URL filters: longest-rule decisions, and logistic regression on hashed character n-grams where no rule fits.

Scoring is a DataFrame expression. The model is fitted in plain Python on a small labelled table (labelled_urls.tsv, another
one may be given), so its size does not depend on the data.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8192
GRAMS = (4, 5)

#: Probability from which the model blocks.
THRESHOLD = 0.8

#: (verdict, host, path) by which urls are judged before the model; the longest rule wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled table: blocked (0 or 1) and url, one in a line.
TABLE = Path(__file__).with_name("labelled_urls.tsv")


def split_url(url: str) -> tuple[str, str]:
    """Host and path, as host_and_path has them."""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def labelled_urls(path: Path = TABLE) -> list[tuple[str, str, int]]:
    """The rows (host, path, blocked) of a labelled table."""
    rows = [line.split("\t") for line in path.read_text("utf-8").splitlines()[1:] if line]
    return [(*split_url(url), int(blocked)) for blocked, url in rows]


FOLDS = 4


def fold(host: str) -> int:
    """The fold of a host's urls, by its hash."""
    return zlib.crc32(host.encode()) % FOLDS


def _grams(s: str) -> set[int]:
    s = f"^{s}$"
    return {zlib.crc32(s[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(s) - n + 1)}


def train(table: list[tuple[str, str, int]]) -> tuple[tuple[float, ...], float]:
    """Weights by bucket and bias, by gradient descent with an L2 penalty (deterministic)."""
    rows = [(sorted(_grams(host + "|" + path)), label) for host, path, label in table]
    order = sorted(range(len(rows)), key=lambda i: zlib.crc32(f"{i}:{table[i][0]}".encode()))
    w, bias = [0.0] * BUCKETS, 0.0
    for epoch in range(100):
        rate = 0.1 / (1 + epoch / 20)
        for grams, label in (rows[i] for i in order):
            e = label - 1 / (1 + math.exp(-bias - sum(w[g] for g in grams)))
            bias += rate * 0.02 * e
            for g in grams:
                w[g] += rate * (e - 2e-3 * w[g])
    return tuple(round(x, 6) for x in w), round(bias, 6)


@lru_cache(maxsize=1)
def weights() -> tuple[tuple[float, ...], float]:
    """The model of the whole labelled table."""
    return train(labelled_urls())


def measured(threshold: float = THRESHOLD) -> tuple[float, float, int]:
    """Precision and recall over the labelled urls, each judged by a model that is trained without its host's fold; and their number."""
    rows, said = labelled_urls(), []
    for k in range(FOLDS):
        w, bias = train([r for r in rows if fold(r[0]) != k])
        said += [(1 / (1 + math.exp(-bias - sum(w[g] for g in _grams(h + "|" + p)))) >= threshold, y) for h, p, y in rows if fold(h) == k]
    hit = sum(1 for yes, y in said if yes and y)
    return hit / max(1, sum(yes for yes, _ in said)), hit / max(1, sum(y for _, y in said)), len(said)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def probability(host: Column, path: Column) -> Column:
    """The model's probability that a url is to be blocked."""
    w, bias = weights()
    table = F.from_json(F.lit(str(list(w))), "array<double>")
    s = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    def grams(s: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.char_length(s) - n + 1), lambda i: F.pmod(F.crc32(F.substring(s, i, F.lit(n)).cast("binary")), F.lit(BUCKETS)).cast("int"))

        long_enough = F.char_length(s) >= max(GRAMS)
        return F.when(long_enough, F.array_distinct(F.concat(*map(of, GRAMS)))).otherwise(F.transform(F.array(s), lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(BUCKETS)).cast("int")))

    found = F.transform(F.array(s), grams)[0]
    z = F.transform(F.array(found), lambda g: F.aggregate(g, F.lit(bias), lambda acc, i: acc + F.get(table, i)))[0]
    return 1 / (1 + F.exp(-z))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """host, path, rule, score and verdict of each url.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule decides, else the
    model blocks at `threshold`. Null urls and urls without :// have empty host and path and go to the model. Only
    page_id and url are read; repeated rows are judged alike, and an empty table gives no rows.
    """
    rows = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    rule, verdict = F, F
    for kind, rh, rp in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        rule, verdict = rule.when(fits, F.lit(rh + rp)), verdict.when(fits, F.lit(kind))
    rows = rows.select("page_id", "host", "path", rule.otherwise(F.lit(None).cast("string")).alias("rule"), verdict.otherwise(F.lit(None).cast("string")).alias("_v"))
    rows = rows.withColumn("score", F.when(F.col("_v").isNull(), probability(h, p)))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
