import random

import numpy as np
import pytest

from quillgraph.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_tokenizer())


def _texts() -> list[str]:
    r = random.Random(5)
    odd = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "   ", "\n\n\n a", "\x1c\x1d x\x85 y", "é" * 50, "'s's 'S don't", "x" * 3000, " " * 999 + "a", "日本語のテスト、ですね。", "12345 67.89", "\r\n\t"]
    odd += ["".join(r.choice("abcdefghij \n'séüß1.,<|endoftxt>😀  \x1f") for _ in range(120)) for _ in range(150)]
    return odd + ["".join(chr(r.choice([r.randrange(32, 1200), r.randrange(0x2000, 0x3100), r.randrange(0x1F300, 0x1F700)])) for _ in range(80)) for _ in range(150)]


def test_counts_and_ids_equal_the_library(library):
    texts, own = _texts(), bpe.ByteBPE(bpe.default_tokenizer())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert [own.count(t) for t in texts] == [len(i) for i in want]
    assert [own.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want] == texts


def test_proposals_fail_and_are_merged_exactly(library):
    own = bpe.ByteBPE(bpe.default_tokenizer())
    vocabulary = [w.decode() for w in list(own.ids)[300:6000] if w.isascii() and w.strip() == w and w.isalpha()]
    r = random.Random(2)
    texts = [r.choice(vocabulary) + r.choice(vocabulary) for _ in range(2000)]
    got = {w: np.frombuffer(b, np.int32).tolist() for w, b in own.encode_words(texts).items()}
    assert any(got[t] != own.propose(t.encode()) for t in texts)
    assert [got[t] for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_queries_on_odd_tables(spark, odd, empty, library):
    by_text = {t: library.encode(t or "", add_special_tokens=False).ids for t in {r.text for r in odd.collect()}}
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(by_text[r.text]), len(by_text[r.text]) > 1024) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(odd).collect()) == want
    full = sorted((str(r.doc_id), r.ids, r.decoded) for r in bpe.encode_documents(odd).collect())
    assert full == sorted((str(r.doc_id), by_text[r.text], r.text or "") for r in odd.collect())
    assert bpe.encode_digests(odd).count() == odd.count()
    assert bpe.count_tokens(empty).count() == bpe.encode_digests(empty).count() == 0
