from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from vantage.llm import packing  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def best_sum(counts, room):
    sums = {0}
    for size, n in counts.items():
        sums = {s + size * k for s in sums for k in range(n + 1) if s + size * k <= room}
    return max(sums)


def test_closest_equals_all_subsets():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randint(1, 60): rng.randint(1, 5) for _ in range(rng.randint(0, 7))}
        room = rng.randint(0, 120)
        used = packing.closest(counts, room)
        assert all(0 < n <= counts[s] for s, n in used.items())
        assert sum(s * n for s, n in used.items()) == best_sum(counts, room)


def placed(counts, window):
    """Every part (size, rank, start, length) with its sequence and offset, from the slots."""
    for whole, low, high, start, length, first, shift, copies, offset in packing.slots(counts, window):
        for rank in range(low, high):
            j = rank - low + shift
            yield (whole, rank, start, length), (first + j // copies, offset + j % copies * length)


def lawful(counts, window):
    parts, sequences = defaultdict(list), defaultdict(list)
    for (size, rank, start, length), (sequence, offset) in placed(counts, window):
        parts[size, rank].append((start, length))
        sequences[sequence].append((offset, length))
    assert set(parts) == {(s, r) for s, n in counts.items() for r in range(n)}
    padding = 0
    for (size, _), own in parts.items():
        assert gapless(own) == size
    for own in sequences.values():
        total = gapless(own)
        assert 0 < total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def gapless(spans):
    at = 0
    for start, length in sorted(spans):
        assert start == at and length > 0
        at += length
    return at


@pytest.mark.parametrize("counts", [{}, {5: 1}, {64: 1}, {64: 7}, {40: 100}, {33: 1000, 1: 3}, {1: 500}, {63: 50, 2: 10, 1: 1}, {64: 3, 40: 31, 23: 9}])
def test_slots_of_hand_made_counts(counts):
    assert lawful(counts, 64) == 0


def test_slots_of_random_counts():
    rng = random.Random(5)
    for _ in range(150):
        assert lawful({rng.randint(1, 64): rng.choice([1, 2, 9, 200]) for _ in range(rng.randint(1, 30))}, 64) == 0


def test_slots_do_not_grow_with_the_counts():
    rng = random.Random(6)
    counts = {s: rng.randint(50, 200) for s in range(1, 400)}
    small, large = packing.slots(counts, 400), packing.slots({s: n * 10**9 for s, n in counts.items()}, 400)
    assert len(large) < 3 * len(small) + 2000
    assert sum((h - lo) * length for _, lo, h, _, length, *_ in large) == sum(s * n * 10**9 for s, n in counts.items())


def check(rows, packed, window):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        want[i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    tokens = {(i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, ids in want}
    assert tokens
    sequences, total, starts = defaultdict(list), 0, Counter()
    texts = defaultdict(list)
    for i, ids in want:
        texts[i, len(ids)].append(ids)
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        assert any(list(own[r["start"]:r["start"] + r["length"]]) == ids for own in texts[r["doc_id"], r["doc_tokens"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
        starts[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert starts == sum((Counter({(i, len(ids)): n * len(ids)}) for (i, ids), n in want.items()), Counter())
    padding = 0
    for own in sequences.values():
        n = gapless(own)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    assert padding == 0
    return sequences


@pytest.mark.parametrize("window", [16, 2048])
def test_pack(make, odd_rows, window):
    rows = odd_rows + [(100 + i, "some words here " * (i % 7)) for i in range(40)] + [(300, None)] * 3
    got = packing.pack(make(rows), PATH, window)
    packed = got.collect()
    check(rows, packed, window)
    joined = packing.sequences(got).collect()
    assert sum(r["n_tokens"] for r in joined) == sum(r["length"] for r in packed)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in joined)


def test_pack_documents_and_nothing(docs, make):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    packed = packing.pack(docs, PATH).collect()
    check(rows, packed, 2048)
    assert packing.digests(make([]), PATH).count() == 0
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
    assert all(gapless(own) for own in by_doc.values()) and len(by_doc) == len({i for i, _ in rows})
    again = packing.digests(docs, PATH).collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in packed)
