"""Sale enrichment and the conversation trie against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from quillgraph.llm import enrichment, trie

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, batch int, slice string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, kind string"
START = datetime(2024, 1, 1)


def _sales_by_plain_replay(sales, changes):
    """The rule row by row: every batch in turn, all versions of a client in one list."""
    cut = lambda d: max(min(11, (d - 19723) * 12 // 152), 0)
    day = lambda t: (t - datetime(1970, 1, 1)).days
    at = defaultdict(lambda: ([], []))
    for s in sales:
        at[cut(day(s[5])) if s[5] else 11][0].append(s)
    for c in set(changes):
        if c[4] is not None:
            at[cut(day(c[4]) + zlib.crc32(str(c[0]).encode()) % 4)][1].append(c)
    out, held, waiting, ws, wc = [], defaultdict(list), [], None, None

    def emit(s, b):
        mine = held[s[1]] if s[1] is not None else []
        fit = [v for v in mine if s[4] is not None and v[0] <= s[4]]
        v = max(fit, key=lambda v: v[:2]) if fit else None
        out.append(("sale", s[0], b, len(mine), *((v[1], v[2], v[3]) if v else (None, None, None))))

    for b in range(12):
        h = min(ws, wc) if ws and wc else None
        for c in at[b][1]:
            if wc is not None and c[4] < wc:
                out.append(("late", c[0], b, None, None, None, None))
            elif c[1] is not None:
                held[c[1]].append((c[4], c[0], int((100 * c[8] + 0.5) // 1), c[3]))
        ready = lambda s: s[4] is None or (h is not None and s[4] < h)  # noqa: E731,B023
        queue = waiting + at[b][0]
        for s in queue:
            if ready(s):
                emit(s, b)
        waiting = [s for s in queue if not ready(s)]
        if h is not None:
            for k, vs in held.items():
                past = sorted(v for v in vs if v[0] <= h)
                held[k] = [v for v in vs if v[0] > h] + past[-1:]
        ws = max([x for x in [ws, *(s[4] for s in at[b][0])] if x], default=None)
        wc = max([x for x in [wc, *(c[4] for c in at[b][1])] if x], default=None)
    for s in waiting:
        emit(s, 12)
    return out


def _shop(seed, n, gaps=()):
    """Sales and changes with a hot client, null and equal times, repeated and late rows; no sale arrives in the days of `gaps`."""
    r = random.Random(seed)
    hour = lambda d: START + timedelta(hours=r.randrange(24 * d))
    client = lambda: r.choice([7, 7, 7, None, *range(8, 16)])
    sales = []
    for i in range(n):
        t = hour(150)
        arrived = t + timedelta(hours=r.choice([0, 1, 30, 500]))
        if (arrived - START).days not in gaps:
            sales.append((i, client(), "done", 1.0, r.choice([t, t, t, t, None]), arrived, 1, 5, "x"))
    sales += sales[:5]
    changes = []
    for i in range(n):
        t = hour(150)
        changes.append((i // 2 if i < 40 else i, client(), i, r.choice("IUD"), r.choice([t, t, t, None]), r.choice("ab"), "s", "c", round(r.uniform(-90, 900), 2), "k"))
    return sales, changes + changes[:20]


@pytest.mark.parametrize(("seed", "n", "slice_ms", "gaps"), [(1, 250, 6 * 3_600_000, range(30, 60)), (2, 120, 40 * 86_400_000, ())])
def test_sales_equal_a_plain_replay(spark, seed, n, slice_ms, gaps):
    sales, changes = _shop(seed, n, gaps)
    got = enrichment.enrich_sales(spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(changes, CHANGES), slice_ms=slice_ms, rows_per_partition=100)
    want = _sales_by_plain_replay(sales, changes)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in got.collect()) == key(want)
    assert {r[0] for r in want} == {"sale", "late"} and any(r[4] is not None for r in want)


def test_sales_of_empty_tables(spark):
    assert enrichment.enrich_sales(spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES), batches=2).count() == 0


TURNS = "conv_id long, turn long, role string, text string, key binary, ends string"


def _trie_by_prefixes(turns):
    own = defaultdict(list)
    for c, t, role, text, *_ in turns:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    member = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            member[s[:d]].append(c)
    kids = defaultdict(list)
    for p in member:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        leaves, saved = (0 if kids[p] else 1), (len(member[p]) - 1) * (len(p[-1][1]) if p else 0)
        for k in kids[p]:
            a, b = under(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, m in list(member.items()):
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seq[c]) == len(p)))
        out.append((min(m), len(p), min(member[p[:-1]]) if p else None, len(m), len(kids[p]), *under(p), hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "block", "piece"), [(1, 4, 65_536), (2, 0, 3), (3, 0, 2)])
def test_trie_equals_prefixes(spark, monkeypatch, seed, block, piece):
    """Common beginnings of all lengths, conversations that end within others, equal ones, missing hosts; blocks of two sequences."""
    monkeypatch.setattr(trie, "PIECE", piece)
    r = random.Random(seed)
    turns = []
    for c in r.sample(range(400), 150):
        for t in range(r.choice([1, 1, 2, 3, 6, 8])):
            turns.append((c, t if r.random() < 0.9 else None, r.choice(["user", None, "system"]) if r.random() < 0.2 else "user", r.choice(["é", "a", "", None, "zz"]) if r.random() < 0.5 else "a", b"k", "e"))
    turns += [(None, 1, "user", "lost", b"", ""), (-5, 0, "user", "x", b"", ""), turns[0]]
    got = trie.conversation_trie(spark.createDataFrame(turns, TURNS).repartition(3), block=block)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, _trie_by_prefixes(turns)))


def test_trie_of_odd_tables(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    alone = trie.conversation_trie(spark.createDataFrame([(0, None, None, None, b"", "")], TURNS)).collect()
    assert {(r.depth, r.n_convs, r.n_children) for r in alone} == {(0, 1, 1), (1, 1, 0)}
