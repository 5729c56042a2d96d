"""Share of the like lines that op9 finds, by number of words and kind of change: python -m tests.llm.line_recall prints the README's table.

Lines are made of words drawn evenly from a fixed vocabulary; truth is the edit distance by plain dynamic programming."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator


def _vocabulary(r: random.Random) -> list[str]:
    parts = ["th", "en", "er", "on", "at", "in", "es", "re", "nd", "ou", "le", "st", "o", "a", "i", "qu", "be", "ch", "m", "t"]
    return ["".join(r.choice(parts) for _ in range(r.choice([1, 2, 2, 3, 3, 4]))) for _ in range(1500)]


def _replaced(r: random.Random, w: list[str], k: int, vocabulary: list[str]) -> str:
    w = list(w)
    for i in r.sample(range(len(w)), k):
        w[i] = r.choice(vocabulary)
    return " ".join(w)


def _inserted(r: random.Random, w: list[str], vocabulary: list[str]) -> str:
    at = r.randrange(len(w) + 1)
    return " ".join([*w[:at], r.choice(vocabulary), *w[at:]])


def _typed(r: random.Random, w: list[str], k: int) -> str:
    t = list(" ".join(w))
    places = [i for i, c in enumerate(t) if c != " "]
    for i in r.sample(places, min(max(k, 1), len(places))):
        t[i] = r.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(t)


KINDS: dict[str, Callable] = {
    "one word replaced": lambda r, w, v: _replaced(r, w, 1, v),
    "one word inserted": _inserted,
    "a tenth of the words replaced": lambda r, w, v: _replaced(r, w, max(1, len(w) // 10), v),
    "a fifth of the words replaced": lambda r, w, v: _replaced(r, w, max(1, len(w) // 5), v),
    "one letter changed": lambda r, w, v: _typed(r, w, 1),
    "two letters changed": lambda r, w, v: _typed(r, w, 2),
    "a letter in twenty changed": lambda r, w, v: _typed(r, w, len(" ".join(w)) // 20),
    "a letter in ten changed": lambda r, w, v: _typed(r, w, len(" ".join(w)) // 10),
    "a letter in seven changed": lambda r, w, v: _typed(r, w, len(" ".join(w)) // 7),
}


def shares(n: int, kinds, met: Callable, pairs: int = 200) -> Iterator[tuple[str, int, float]]:
    """(kind, like pairs, share of them found) for lines of n words."""
    for kind in kinds:
        r = random.Random(f"{n} {kind}")
        vocabulary = _vocabulary(r)
        base = [[r.choice(vocabulary) for _ in range(n)] for _ in range(pairs)]
        yield kind, *met([" ".join(w) for w in base], [KINDS[kind](r, w, vocabulary) for w in base])


if __name__ == "__main__":
    from tests.llm.test_groups import _met

    sizes = (2, 3, 5, 8, 10, 15, 20, 30, 60, 200)
    found = {(kind, n): f"{share:.2f}" if like >= 10 else "-" for n in sizes for kind, like, share in shares(n, KINDS, _met, 400 if n < 60 else 200)}
    print("| Words |", " | ".join(map(str, sizes)), "|")
    print("|---" * (len(sizes) + 1) + "|")
    for kind in KINDS:
        print("|", kind, "|", " | ".join(found[kind, n] for n in sizes), "|")
