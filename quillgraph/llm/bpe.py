"""Byte-level BPE: token counts by heap-and-linked-list merging, and encoding by speculation and verification."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import map_batches

#: Words remembered by one Python worker; beyond that only short ones, which return most, are kept (results do not depend on it).
REMEMBERED = 200_000
_SHORT_WORD, _LONG_WORD = 8, 64  # longer words than the latter are not remembered

#: The byte-level splitting pattern (fixed values of the public tokenizer), white space by its Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _thin(known: dict[str, object]) -> None:
    """Drops long words, or all if too many are short."""
    kept = {w: v for w, v in known.items() if len(w) <= _SHORT_WORD}
    known.clear()
    if len(kept) < REMEMBERED // 2:
        known.update(kept)


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {to_bytes(k): v for k, v in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens = [b""] * size
        for k, v in self.ids.items():
            self.tokens[v] = k
        for k, v in self.special.items():
            self.tokens[v] = k.encode()
        self.names = [str(i) for i in range(size)]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.reach: dict[bytes, int] = {}  # the longest token with these first bytes (three, or all of a shorter one)
        for k in self.ids:
            for start in {k[:1], k[:2], k[:3]}:
                self.reach[start] = max(self.reach.get(start, 0), len(k) if len(start) == 3 else min(len(k), 2))
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.counts: dict[str, int] = {}
        self.encoded: dict[str, bytes] = {}  # ids as 32-bit integers
        self.pairs = np.zeros(0, np.int64)  # sorted keys of tested pairs
        self.fits = np.zeros(0, bool)

    def pieces(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """(special token or None, words) in order; special strings inside the text are tokens, as is the library's default."""
        if self.cut is None or not any(s in text for s in self.special):
            yield None, self.find(text)
            return
        for part in self.cut(text):
            if part in self.special:
                yield part, []
            elif part:
                yield None, self.find(part)

    def merge(self, word: bytes) -> tuple[list[int], int]:
        """Exact merging of one word: the lowest-rank adjacent pair, the leftmost among equals, is merged until none is left.

        The symbols form a linked list, the candidate pairs a heap; an entry whose symbols have changed since is skipped.
        Returns the symbols that are left and the number of merges.
        """
        sym = [self.byte_ids[b] for b in word]
        n = len(sym)
        if n < 2:
            return sym, 0
        ranks, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := ranks.get((sym[i], sym[i + 1]))) is not None:
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (m := ranks.get((new, sym[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            if (h := before[i]) >= 0 and (m := ranks.get((sym[h], new))) is not None:
                heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return [s for s in sym if s >= 0], done

    def count(self, text: str) -> int:
        """Tokens of a text: initial symbols minus merges, word by word; no identifiers are produced."""
        known, total = self.counts, 0
        for special, found in self.pieces(text):
            total += special is not None
            for w in found:
                if (n := known.get(w)) is None:
                    raw = w.encode()
                    n = len(raw) - self.merge(raw)[1]
                    if len(w) <= _LONG_WORD:
                        if len(known) >= REMEMBERED:
                            _thin(known)
                        known[w] = n
                total += n
        return total

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest-match tokens."""
        out, at, n, ids, reach = [], 0, len(word), self.ids, self.reach
        while at < n:
            end = min(n, at + (reach.get(word[at : at + 3]) or reach.get(word[at : at + 2]) or 1))
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def _fitting(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (key = left * size + right; right = size - 1 + 1 stands for a token by itself) survives exact merging."""
        size = len(self.tokens) + 1
        unique, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pairs, unique)
        known = (at < len(self.pairs)) & (self.pairs[np.minimum(at, max(len(self.pairs) - 1, 0))] == unique if len(self.pairs) else False)
        new = unique[~known]
        if len(new):
            flags = np.empty(len(new), bool)
            for k, key in enumerate(new.tolist()):
                a, b = divmod(key, size)
                flags[k] = self.merge(self.tokens[a])[0] == [a] if b == size - 1 else self.merge(self.tokens[a] + self.tokens[b])[0] == [a, b]
            if len(self.pairs) > 4_000_000:
                self.pairs, self.fits = self.pairs[:0], self.fits[:0]
                known = np.zeros(len(unique), bool)
                return self._fitting(keys)
            order = np.argsort(merged := np.concatenate([self.pairs, new]), kind="stable")
            self.pairs, self.fits = merged[order], np.concatenate([self.fits, flags])[order]
        return self.fits[np.searchsorted(self.pairs, unique)][back]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as 32-bit integers. Greedy proposals stand if every adjacent pair of their tokens (and a lone token) would
        itself come out of exact merging; the pairs of all words are tested at once, only failing words are merged exactly."""
        words = list(words)
        if not words:
            return {}
        size = len(self.tokens) + 1
        proposals = [self.propose(w.encode()) for w in words]
        lengths = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        nxt = np.empty_like(flat)
        nxt[:-1] = flat[1:]
        nxt[ends - 1] = size - 1
        tested = np.ones(len(flat), bool)
        tested[ends - 1] = lengths == 1  # the last token of a longer word has no right neighbour
        ok = np.ones(len(flat), bool)
        ok[tested] = self._fitting(flat[tested] * size + nxt[tested])
        good = np.minimum.reduceat(ok, starts)
        packed = flat.astype(np.int32).tobytes()
        spans = zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)
        return {w: packed[i:j] if g else np.array(self.merge(w.encode())[0], np.int32).tobytes() for w, (i, j), g in zip(words, spans, good.tolist(), strict=True)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        known = self.encoded
        split = [list(self.pieces(t)) for t in texts]
        new = set(chain.from_iterable(found for parts in split for _, found in parts)).difference(known)
        if len(known) + len(new) > REMEMBERED:
            _thin(known)
            new = set(chain.from_iterable(found for parts in split for _, found in parts)).difference(known)
        known.update(self.encode_words(new))
        out = []
        for parts in split:
            ids = bytearray()
            for special, found in parts:
                ids += np.int32(self.special[special]).tobytes() if special is not None else b"".join(map(known.__getitem__, found))
            out.append(np.frombuffer(bytes(ids), np.int32).tolist())
        for w in new:
            if len(w) > _LONG_WORD:
                del known[w]
        return out

    def forget(self) -> None:
        """Drops what was remembered."""
        self.counts.clear()
        self.encoded.clear()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def _groups(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about a quarter of a million characters (null: empty), so that one step's memory stays bounded."""
    at, size, out = 0, 0, []
    for i in range(len(texts)):
        t = texts[i].as_py() or ""
        out.append(t)
        size += len(t)
        if size >= limit:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text; null texts count as empty (0 tokens).

    Each text is handled alone: no shuffle, repeated rows give repeated results, an empty table an empty one.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n_bytes, n_tokens = [], []
            for _, texts in _groups(b.column("text")):
                n_bytes += [len(t.encode()) for t in texts]
                n_tokens += [bpe.count(t) for t in texts]
            tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), tokens, pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        bpe.forget()

    return map_batches(documents.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, token ids and the text decoded from them, for every whole text; null texts count as empty (no ids, "")."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for at, texts in _groups(b.column("text")):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])
        bpe.forget()

    return map_batches(documents.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, made where the ids are made."""
    path = path or default_tokenizer()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            sizes, of_ids, of_text = [], [], []
            for _, texts in _groups(b.column("text")):
                for ids in bpe.encode(texts):
                    sizes.append(len(ids))
                    of_ids.append(digest(",".join(map(bpe.names.__getitem__, ids))))
                    of_text.append(digest(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return map_batches(documents.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
