"""Selections that are sequential by nature, over candidates that fit the driver: greedy diversified picks, editorial lists,
daily schedules, stratified samples. Candidates come from the ranked, bounded results of the other operators."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable
from datetime import date, timedelta

from quillgraph.sources.datasets import content_hash


def greedy_diversified(candidates: list[dict], keys: tuple[str, ...], target: int, max_uses: int = 3) -> list[dict]:
    """Repeatedly takes the candidate of the best score after a penalty for keys in use (score / (1 + uses), id rising), none
    of whose keys is used max_uses times already."""
    left, used, out = list(candidates), Counter(), []
    while left and len(out) < target:
        open_ = [c for c in left if all(used[c[k]] < max_uses for k in keys)]
        if not open_:
            break
        best = min(open_, key=lambda c: (-c["score"] / (1 + sum(used[c[k]] for k in keys)), c["id"]))
        out.append(best)
        left.remove(best)
        used.update(best[k] for k in keys)
    return out


def editorial_shortlist(pairs: list[dict], ends: tuple[str, str], size: int = 20, max_uses: int = 2) -> list[dict]:
    """By score, each end at most max_uses times; then filled up from those passed over."""
    ordered = sorted(pairs, key=lambda p: (-p["score"], p["id"]))
    used, out, rest = Counter(), [], []
    for p in ordered:
        if len(out) < size and all(used[p[e]] < max_uses for e in ends):
            out.append(p)
            used.update(p[e] for e in ends)
        else:
            rest.append(p)
    return out + rest[: size - len(out)]


def seeded_shuffle(items: Iterable, seed: str) -> list:
    out = list(items)
    random.Random(seed).shuffle(out)
    return out


def without_adjacent_conflicts(items: list[dict], key: str) -> list[dict]:
    """One forward pass: an item like its predecessor changes places with the next one that is not."""
    out = list(items)
    for i in range(1, len(out)):
        if out[i][key] == out[i - 1][key]:
            j = next((j for j in range(i + 1, len(out)) if out[j][key] != out[i - 1][key]), None)
            if j is not None:
                out[i], out[j] = out[j], out[i]
    return out


def daily_schedule(rounds: list[dict], start: str, days: int, seed: str, key: str = "artist_id") -> dict:
    """One round a day from `start`, shuffled by seed, repeats of a key kept apart, with a fingerprint of the whole."""
    ordered = without_adjacent_conflicts(seeded_shuffle(sorted(rounds, key=lambda r: r["id"]), seed), key)
    first = date.fromisoformat(start)
    entries = [{"date": (first + timedelta(days=i)).isoformat(), "round_id": r["id"]} for i, r in zip(range(days), ordered)]
    return {"start": start, "entries": entries, "fingerprint": content_hash(entries)}


def extend_schedule(schedule: dict, rounds: list[dict], days: int, seed: str, key: str = "artist_id") -> dict:
    """Appends days; what is scheduled already stays as it is, and no round comes twice."""
    used = {e["round_id"] for e in schedule["entries"]}
    nxt = (date.fromisoformat(schedule["entries"][-1]["date"]) + timedelta(days=1)).isoformat() if schedule["entries"] else schedule["start"]
    more = daily_schedule([r for r in rounds if r["id"] not in used], nxt, days, seed, key)
    entries = schedule["entries"] + more["entries"]
    return {"start": schedule["start"], "entries": entries, "fingerprint": content_hash(entries)}


def schedule_failures(schedule: dict, rounds: list[dict]) -> list[str]:
    """Gaps between days, repeated or unknown rounds, a wrong fingerprint."""
    known, out, seen = {r["id"] for r in rounds}, [], set()
    days = [date.fromisoformat(e["date"]) for e in schedule["entries"]]
    out += [f"gap after {a}" for a, b in zip(days, days[1:]) if b - a != timedelta(days=1)]
    for e in schedule["entries"]:
        if e["round_id"] in seen:
            out.append(f"round {e['round_id']} comes twice")
        if e["round_id"] not in known:
            out.append(f"round {e['round_id']} is unknown")
        seen.add(e["round_id"])
    if schedule["fingerprint"] != content_hash(schedule["entries"]):
        out.append("the fingerprint is wrong")
    return out


def stratified_pairs(degrees: dict[int, int], count: int) -> list[tuple[int, int]]:
    """Pairs of ids taken in turn from the thirds of the ids by degree, evenly spread within each."""
    ids = sorted(degrees, key=lambda i: (degrees[i], i))
    third = max(1, -(-len(ids) // 3))
    strata = [ids[k : k + third] for k in range(0, len(ids), third)]
    combos = [(a, b) for i, a in enumerate(strata) for b in strata[i:]]
    out, step = [], 0
    while len(out) < count and combos and step < count * 4:
        a, b = combos[step % len(combos)]
        k = step // len(combos)
        x, y = a[(k * 7) % len(a)], b[(k * 11 + 1) % len(b)]
        if x != y and (x, y) not in out and (y, x) not in out:
            out.append((x, y))
        step += 1
    return out
