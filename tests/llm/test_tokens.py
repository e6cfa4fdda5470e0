from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from vantage.llm import bpe, token_counts  # noqa: E402


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def noise(rng, n):
    parts = ["the ", "  ", "\n\n", " Ünï", "漢字", "🎉", "don't", "<|endoftext|>", "<s>", "▁", "x" * 9, "=-=", " 12345", "\t", " ", "'s", "!'s", " a", "\x00", "é", "''", "://", " </s>"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_chunks_equal_whole(pieces):
    rng = random.Random(1)
    for chunk, overlap in ((64, 4), (200, 8), (1000, 16)):
        encoder = token_counts.ChunkedEncoder(P.path("piece_bpe_32k.model"), chunk, overlap)
        for text in [noise(rng, n) for n in (0, 1, 30, 300, 900)] + ["a" * 1500, " " * 700, "x" + " " * 300 + "y", "漢" * 800, "ab" * 900]:
            assert encoder.ids(text).tolist() == pieces.encode(text), (chunk, text[:60])


def test_token_counts(pieces, make, odd_rows, docs):
    got = token_counts.token_counts(make(odd_rows), P.path("piece_bpe_32k.model")).collect()
    assert Counter(map(tuple, got)) == Counter((d, len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 4096) for d, t in odd_rows)
    assert token_counts.token_counts(make([]), P.path("piece_bpe_32k.model")).count() == 0
    rows = docs.collect()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()}
    assert got == {r["doc_id"]: len(pieces.encode(r["text"] or "")) for r in rows}


def test_fragments_equal_whole(whole):
    rng, codec = random.Random(2), bpe.FragmentCodec(P.path("byte_bpe_50k.json"), keep=50)
    for n in (0, 1, 2, 5, 20, 200, 2000):
        for _ in range(60 if n < 100 else 5):
            text = noise(rng, n)
            ids = whole.encode(text, add_special_tokens=False).ids
            assert codec.encode(text).tolist() == ids, text
            assert codec.decode(ids) == whole.decode(ids, skip_special_tokens=False)
    assert codec.decode([255]) == whole.decode([255], skip_special_tokens=False)


def test_blocks_keys_and_memory(whole, monkeypatch):
    """Blocks cut long texts anywhere, equal keys of different fragments and a full table change nothing."""
    rng = random.Random(4)
    texts = [noise(rng, n) for n in (0, 3, 700, 0, 40, 3000, 1)] + ["x" * 5000, "", "a b" * 4000, "<|endoftext|>" * 300]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for block, keep, key in ((64, 1 << 20, None), (1000, 20_000, None), (1 << 20, 1 << 20, 1), (300, 17_000, 3)):
        monkeypatch.setattr(bpe.FragmentCodec, "BLOCK", block)
        codec = bpe.FragmentCodec(P.path("byte_bpe_50k.json"), keep=keep)
        if key:
            codec.letter_key[:], codec.place_key[:] = np.uint64(key), np.uint64(1)  # only the length tells fragments apart
        for _ in range(2):
            assert [i.tolist() for i in codec.encode_all(texts)] == want
        assert [codec.decode(i) for i in want] == texts
        assert codec.raw_size.max(initial=0) <= codec.LONG


def test_characters_in_pairs(whole):
    """Every pair of some hundred characters of all kinds, between letters and spaces."""
    chars = [chr(c) for c in range(32, 127)] + list("\n\t  　\u0085​éßÉñ漢🎉́²½Ⅷ٣")
    codec = bpe.FragmentCodec(P.path("byte_bpe_50k.json"))
    texts = ["".join(x) for a in chars for x in [[f"q{a}{b} {a}s{b}" for b in chars]]]
    for text, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text).tolist() == e.ids


def test_digests(whole, make, odd_rows, docs):
    def want(d, t):
        ids = whole.encode(t or "", add_special_tokens=False).ids
        return d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    path = P.path("byte_bpe_50k.json")
    assert Counter(map(tuple, bpe.digests(make(odd_rows), path).collect())) == Counter(want(*r) for r in odd_rows)
    assert Counter(map(tuple, bpe.digests(docs, path).collect())) == Counter(want(r["doc_id"], r["text"]) for r in docs.collect())
    assert bpe.digests(make([]), path).count() == 0
    back = bpe.decode(bpe.encode(make(odd_rows), path), path)
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect()) and "key" in back.columns
