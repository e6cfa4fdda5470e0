from __future__ import annotations

import duckdb
import numpy as np
import pytest

from vantage.llm import hard_negatives as H
from vantage.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows):
    """Every anchor against every row."""
    points = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        points.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    out = []
    for a in points:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], p[2])), p[0], p[1]) for p in points if p != a)
        for s, i, _ in [x for x in scored if x[2] == a[1]][:5]:
            within = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[0], i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(within)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cell", "'x' AS v", "1 AS own")
    return sorted(map(tuple, H.mine(H.prepared(df), **options).collect()))


def clustered(rng, n, dims=16, groups=12):
    middles = rng.normal(size=(groups, dims))
    return [(i, (middles[rng.integers(groups)] + rng.normal(size=dims) * 0.2).astype(np.float32).tolist(), int(rng.integers(5))) for i in range(n)]


@pytest.mark.parametrize("codes", [1, 3, 8])
def test_equals_brute_force(spark, codes):
    rows = clustered(np.random.default_rng(codes), 900)
    assert mined(spark, rows, codes=codes) == slow(rows)


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = clustered(rng, 120, 4)
    rows += [(i, [0.5, 0.5, 0.0, 0.0], i % 3) for i in range(200, 520)]  # one vector in many rows
    rows += [rows[0], rows[0], (100, None, 1), (300, [0.1, None, 0.1, 0.2], 1), (400, [float("nan")] * 4, 1), (700, [float("inf")] * 4, 1),
             (800, [0.1] * 4, None), (None, [0.1] * 4, 1), (900, [0.0] * 4, 1), (1000, [1.0, 0.5], 2), (1100, [], 3), (200, [0.5, 0.5, 0.1, 0.0], 2)]
    filled = [(i, v if v is None else [*v, *[0.0] * (4 - len(v))], label) for i, v, label in rows]
    assert mined(spark, rows, codes=3) == slow(filled)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, None, 1)]) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [1e5 + i, 2e5 - i, 3e5, 1e5 * (i % 3)], i % 2) for i in range(60)] + [(100, [1e5, 2e5, 3e5, 0.0], 1)]
    assert mined(spark, rows) == slow(rows)
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(100, [1e30], 1), (101, [1.0], 1)])


def test_cells_come_in_order_of_bounds_that_hold():
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, (400, 8)).astype(np.int32)
    books = [H.codebook(x[:, :4], 5), H.codebook(x[:, 4:], 5)]
    i, j = H.nearest(x[:, :4], books[0]), H.nearest(x[:, 4:], books[1])
    radii = [np.array([max(np.linalg.norm(x[c == k][:, s] - b[k], axis=1), default=0) for k in range(5)]) for c, s, b in ((i, slice(0, 4), books[0]), (j, slice(4, 8), books[1]))]
    counts = np.zeros((5, 5), int)
    np.add.at(counts, (i, j), 1)
    index, v = H.MultiIndex(books, radii, counts), x[7]
    scores, everything = x.astype(int) @ v.astype(int), [(H.LOWEST, H.HIGHEST)]
    cells, after = index.visits(v, everything, 0, 10**6)
    assert sorted(cells) == np.flatnonzero(counts).tolist() and after == float("-inf")
    upper = [index.half_bounds(v)[0][1][c // 5] + index.half_bounds(v)[1][1][c % 5] for c in cells]
    assert upper == sorted(upper, reverse=True)
    assert all(scores[(i == c // 5) & (j == c % 5)].max() <= u for c, u in zip(cells, upper))
    halves = [index.visits(v, everything, a, b) for a, b in ((0, 100), (100, 250), (250, 10**6))]
    assert sum((c for c, _ in halves), []) == cells
    assert halves[0][1] == upper[len(halves[0][0])]
    high = int(np.sort(scores)[300])
    chosen, _ = index.visits(v, [(high, high)], 0, 10**6)
    assert {c for c in cells if (scores[(i == c // 5) & (j == c % 5)] == high).any()} <= set(chosen) <= set(cells)


def test_certified_windows_stop(spark):
    """On well separated groups most cells are never visited."""
    rows = clustered(np.random.default_rng(3), 3000, 16, 40)
    points, index = H.build(H.prepared(spark.createDataFrame(rows, SCHEMA)), codes=16)
    v = H.matrix([bytes(points.where("vec_id = 100").first()["v"])])[0]
    cells, bound = index.visits(v, [(H.LOWEST, H.HIGHEST)], 0, 300)
    assert 0 < len(cells) < np.count_nonzero(index.counts) / 2 and bound > float("-inf")


def test_reference_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = sorted(con.execute(f"SELECT {names} FROM ({queries.OP13_SQL})").fetchall())
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, "/root/testdata/sf0.001").select(*names.split(", ")).collect()))
    assert got == want and want
