"""Ranked candidates from saved HTML list pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_RANK = re.compile(r"^\s*#?(\d{1,4})\s*[.):\-]\s*(.*)$", re.S)
_YEAR = re.compile(r"\(\s*((?:19|20)\d{2})\s*\)\s*$")
_SPLIT = re.compile(r"\s+[-–—]\s+")
_MASTER, _RELEASE = re.compile(r"/master/(\d+)"), re.compile(r"/release/(\d+)")

# The classes of cards on pages that list releases in blocks; they must be these for right results.
CARD, CARD_TITLE, CARD_ARTIST, CARD_YEAR = "release-block-info", "release-block-title", "release-block-artist", "release-block-year"

SCHEMA = "page_id long, rank int, artist string, title string, year int, master_hint long, release_hint long, confidence string"


class _Items(HTMLParser):
    """Texts and links of list items; a page without any uses its headings and paragraphs."""

    def __init__(self):
        super().__init__()
        self.items: dict[str, list[tuple[str, list[str]]]] = {"li": [], "block": []}
        self.open: list[tuple[str, list[str], list[str]]] = []
        self.skip = 0
        self.cards: list[dict] = []
        self.inside: list[tuple[str, str]] = []  # open elements within a card, with what their text is

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if CARD in classes and not self.inside:
            self.cards.append({CARD_TITLE: "", CARD_ARTIST: "", CARD_YEAR: "", "links": []})
            self.inside.append((tag, CARD))
        elif self.inside and tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.inside.append((tag, next((c for c in (CARD_TITLE, CARD_ARTIST, CARD_YEAR) if c in classes), self.inside[-1][1])))
        if tag == "a" and self.inside:
            self.cards[-1]["links"].append(dict(attrs).get("href") or "")
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "li" or tag in ("h2", "h3", "h4", "p"):
            self.open.append((tag, [], []))
        if tag == "a" and self.open:
            self.open[-1][2].append(dict(attrs).get("href") or "")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if any(t == tag for t, _ in self.inside):
            while self.inside.pop()[0] != tag:
                pass
        if self.open and self.open[-1][0] == tag:
            t, text, links = self.open.pop()
            self.items["li" if t == "li" else "block"].append((" ".join("".join(text).split()), links))

    def handle_data(self, data):
        if self.inside and self.inside[-1][1] != CARD and not self.skip:
            self.cards[-1][self.inside[-1][1]] += data
        if self.open and not self.skip:
            self.open[-1][1].append(data)


def candidates(html: str) -> list[dict]:
    """`N. Artist - Title (Year)` entries in page order, of list items, else of cards (title, artist and year in elements of
    their own), else of headings and paragraphs; entries without a rank are numbered by their place if no entry has one."""
    p = _Items()
    p.feed(html or "")
    p.close()
    for kind in ("li", "card", "block"):
        if kind == "card":
            rows = [r for c in p.cards if (r := _card(c))]
        else:
            rows = [r for text, links in p.items[kind] if (r := _entry(text, links))]
        if rows:
            ranked = [r for r in rows if r["rank"] is not None]
            if ranked:
                return ranked
            return [r | {"rank": i} for i, r in enumerate(rows, 1)]
    return []


def _card(card: dict) -> dict | None:
    artist, title = (" ".join(card[k].split()) for k in (CARD_ARTIST, CARD_TITLE))
    if not artist or not title:
        return None
    year = re.search(r"(?:19|20)\d{2}", card[CARD_YEAR])
    master, release = _hint(_MASTER, card["links"]), _hint(_RELEASE, card["links"])
    sure = "high" if (master or release) and year else "medium" if master or release or year else "low"
    return {"rank": None, "artist": artist, "title": title, "year": int(year[0]) if year else None, "master_hint": master, "release_hint": release, "confidence": sure}


def _hint(pattern: re.Pattern, links: list[str]) -> int | None:
    return next((int(m[1]) for x in links if (m := pattern.search(x))), None)


def _entry(text: str, links: list[str]) -> dict | None:
    rank = None
    if m := _RANK.match(text):
        rank, text = int(m[1]), m[2].strip()
    year = None
    if m := _YEAR.search(text):
        year, text = int(m[1]), text[: m.start()].strip()
    parts = _SPLIT.split(text, maxsplit=1)
    if len(parts) != 2 or not all(parts):
        return None
    master, release = _hint(_MASTER, links), _hint(_RELEASE, links)
    sure = "high" if (master or release) and rank else "medium" if rank or master or release else "low"
    return {"rank": rank, "artist": parts[0], "title": parts[1], "year": year, "master_hint": master, "release_hint": release, "confidence": sure}


def extract_candidates(pages: DataFrame) -> DataFrame:
    """Candidates of each page (page_id, html), page by page on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "rank", "artist", "title", "year", "master_hint", "release_hint", "confidence"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = [{"page_id": i} | c for i, h in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True) for c in candidates(h)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)
