from __future__ import annotations

import random
import re
import string
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SF
from vantage.llm import neardup


def brute(rows, threshold=0.8):
    """Classes by comparing all pairs."""
    shingler = neardup.Shingler()
    sets = [(d, shingler.shingles(shingler.words(t))) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and neardup.likeness(x, y) >= threshold:
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {d: top(d) for d in parent}


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows, n = [], 0
    for _ in range(12):
        base = text(rng.choice([3, 40, 150, 400]))
        for share in [0, 0, 0.005, 0.01, 0.02, 0.03, 0.05]:
            rows.append((n := n + 1, edited(rng, base, share) if share else base))
    base = text(120)
    rows += [(n + i, edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.06]))) for i in range(1, 90)]
    rows += [(n + 100 + i, text(rng.choice([1, 2, 4, 5, 6, 80]))) for i in range(40)]
    rng.shuffle(rows)
    return rows


def test_groups_against_all_pairs(make, planted, odd_rows):
    rows = planted + [(d + 5000 if d else d, t) for d, t in odd_rows]
    got = {r["doc_id"]: r["class_id"] for r in neardup.groups(make(rows)).collect()}
    assert got.pop(None) is None
    assert got == brute(rows)
    assert neardup.groups(make(rows)).count() == len(rows)


def test_blocks_of_any_size(make, planted, monkeypatch):
    whole = neardup.links
    monkeypatch.setattr(neardup, "links", lambda m, s, t: whole(m, s, t, small=2, block=2000))
    assert {r["doc_id"]: r["class_id"] for r in neardup.groups(make(planted)).collect()} == brute(planted)


def test_groups_of_given_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["class_id"] for r in neardup.groups(docs).collect()} == brute(rows), SF


def test_one_of_each_group_stays(make, odd_rows):
    rows = odd_rows
    kept = neardup.keep_first(make(rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8] and ids.count(None) == 1
    assert kept.columns == make(rows).columns
    assert neardup.groups(make([])).count() == 0 and neardup.keep_first(make([])).count() == 0


def test_weighted_signature_estimates_likeness():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = rng.gamma(2, 1, 300), rng.gamma(2, 1, 300)
    ranks = neardup.dart_minhash(np.concatenate([elements, elements]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 4000)
    assert abs((ranks[0] == ranks[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    again = neardup.dart_minhash(elements, b, np.zeros(300, int), 1, 4000)
    assert np.array_equal(again[0], ranks[1])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(15)]
    got = {r["id"]: r["root"] for r in neardup.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((top(u), top(v)))
            parent[b] = a
    assert got == {x: top(x) for x in parent if x != top(x)}


def test_blocks_of_many_short_texts_are_bounded(spark):
    """Texts of 3 shingles, two of them in all: no links, all strays."""
    rows, height = 5000, 500
    open_rows = spark.range(rows).selectExpr("7L bucket", "id", "id root", "3L n", "id > 0 stray")
    dealt = neardup._dealt(open_rows, 200_000, height).groupBy("bucket", "i", "j").agg({"id": "count"}).collect()
    assert max(r[-1] for r in dealt) < 2.5 * height and sum(r[-1] for r in dealt) == (2 * rows - 1) * (rows // height + 1)

    count = 3000
    sets = [np.array([1, 2, 10 + i // 2]) for i in range(count)]
    ids = np.arange(count)
    tracemalloc.start()
    found = neardup.block_links(np.tile(ids, 2), np.tile(ids, 2), sets * 2, np.arange(2 * count) < count, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [(i, i + 1, 1.0) for i in range(0, count, 2)]
    assert peak < 12 * count * 2 * count


def test_equal_texts_without_words_are_one_group(make):
    rows = [(1, "-----"), (2, "-----"), (3, "!!!"), (4, "----"), (5, ""), (6, ""), (7, "!!!"), (8, None), (9, "some words")]
    got = {r["doc_id"]: r["class_id"] for r in neardup.groups(make(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 3, 8: 8, 9: 9}
    assert {r["doc_id"] for r in neardup.keep_first(make(rows)).collect()} == {1, 3, 4, 5, 6, 8, 9}


def test_texts_that_share_an_id_keep_their_own_links(make):
    t, u = (" ".join(f"{w}{i}" for i in range(40)) for w in "tu")
    rows = [(1, t), (1, u), (2, t + " x"), (3, u + " y"), (4, "quite another text that stands alone here"), (4, t + " z"), (None, u)]
    got = Counter(tuple(r) for r in neardup.groups(make(rows)).select("doc_id", "class_id").collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 1), (None, 1)])
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.keep_first(make(rows)).collect() if r["doc_id"] is not None)
    assert kept == sorted([(1, t), (1, u), (4, rows[4][1])])
    near = [(7, t), (7, t + " x"), (8, t)]  # one id, two texts of one group
    assert len(neardup.keep_first(make(near)).collect()) == 1


def test_recall_of_every_fiftieth_document(spark):
    """Queries of an id divisible by 50 against all rows, by weighted likeness of shingles of five words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    kinds, texts = {r["doc_id"]: r["class_id"] for r in neardup.groups(docs).collect()}, docs.collect()
    bags = {}
    for r in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        bags[r["doc_id"]] = Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    asked = {i: b for i, b in bags.items() if i % 50 == 0 and b}
    holders = {}
    for i, b in asked.items():
        for g in b:
            holders.setdefault(g, []).append(i)
    shared = Counter()
    for j, b in bags.items():
        for g, n in b.items():
            for i in holders.get(g, ()):
                shared[i, j] += min(n, asked[i][g])
    links = {(i, j) for (i, j), n in shared.items() if i != j and n >= 0.8 * (asked[i].total() + bags[j].total() - n)}
    found = {(i, j) for i, j in links if kinds[i] == kinds[j]}
    assert len(links) > 50 and len(found) >= 0.99 * len(links)
