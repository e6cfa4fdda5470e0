"""Hard negatives from an inverted multi-index, exactly.

Vectors are halved; a codebook for each half, learned from a bounded sample, gives every row a cell (one code a half).
A row's score with an anchor is at most the sum over the halves of anchor . code + |anchor| * radius of the code, so a
heap over the two code lists, each in falling order of that bound, visits cells in falling order of the summed bounds.
A search window (a range of scores) is certified once its k-th best row beats the bound of every cell not visited; cells
whose bounds miss the window altogether are passed over.

Anchors visit cells in rounds that take eight times as many rows each; only anchors with an open window go on.  Rows are
dealt by cell, and by hash within a cell, so a vector that a third of the rows share fills many tasks; a task keeps one
part of a cell as a matrix and lets the anchors that visit it stream by.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vantage.session import materialize

SAMPLE = 4096
PART_ROWS = 16_384
FOUND = "own string, w int, score long, vec_id long"
WINDOWS = "array<struct<w:int,low:long,high:long>>"
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, label, v) that take part: every component x as floor(256 x), in four little-endian bytes.

    Rows with a null id, label or vector, or a null or non-finite component are left out.  Where the id is divisible by
    7 the label becomes (label + 1) % 10.  Shorter vectors are filled up with zeros.  A component whose 256-fold does
    not fit in four bytes stops the job, as scores would not fit a long.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    label = F.col(label_col)
    taken = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    dims = taken.agg(F.max(F.size(x)).alias("n")).first()["n"] or 0
    dims += dims % 2

    @pandas_udf("binary")
    def whole(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            q = np.floor(256 * np.asarray(v, dtype=np.float64))
            if len(q) and np.abs(q).max() >= 1 << 31:
                raise OverflowError("a component is too large for whole scores")
            out.append(np.pad(q, (0, dims - len(q))).astype("<i4").tobytes())
        return pd.Series(out, dtype=object)

    return taken.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label).cast("int").alias("label"), whole(x).alias("v"),
    )


def matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; in floating point where every partial sum fits 53 bits."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) >= 1 << 53:
        return np.array(a.astype(object) @ b.T.astype(object)).astype(np.int64)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def codebook(sample: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Means of `codes` groups of the sample's rows, started at rows far from those taken before."""
    x = sample.astype(np.float64)
    picked = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(picked) < codes:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    means = x[picked]
    for _ in range(rounds):
        own = nearest(x, means)
        counts = np.bincount(own, minlength=codes)
        sums = np.zeros_like(means)
        np.add.at(sums, own, x)
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means**2).sum(1) - 2 * x @ means.T).argmin(1)


class MultiIndex:
    """Two codebooks, the radius of every code and the rows of every cell."""

    def __init__(self, books: list[np.ndarray], radii: list[np.ndarray], counts: np.ndarray):
        self.books, self.radii, self.counts = books, radii, counts

    def half_bounds(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the least and the largest score that a row of each code can have with v."""
        out, at = [], 0
        for means, radius in zip(self.books, self.radii, strict=True):
            half = v[at:at + means.shape[1]].astype(np.float64)
            at += means.shape[1]
            middle, reach = means @ half, np.linalg.norm(half) * radius
            slip = 1e-9 * (np.abs(middle) + reach) + 1e-3  # rounding of the bounds themselves
            out.append((middle - reach - slip, middle + reach + slip))
        return out

    def visits(self, v: np.ndarray, windows: list[tuple[int, int]], start: int, end: int) -> tuple[list[int], float]:
        """Cells, by falling bound, that a search over rows number `start` to `end` visits, and the bound of the next.

        Rows are counted in the order of the visit, cells that miss every window left out; a cell belongs to the round
        in which its first row falls.
        """
        (low1, up1), (low2, up2) = self.half_bounds(v)
        first, second = np.argsort(-up1, kind="stable"), np.argsort(-up2, kind="stable")
        heap, seen, taken, cells = [(-(up1[first[0]] + up2[second[0]]), 0, 0)], {(0, 0)}, 0, []
        while heap:
            bound, a, b = heapq.heappop(heap)
            i, j = int(first[a]), int(second[b])
            least, most = low1[i] + low2[j], -bound
            n = int(self.counts[i, j])
            if n and any(low <= most and least <= high for low, high in windows):
                if taken >= end:
                    return cells, most
                if taken >= start:
                    cells.append(i * self.counts.shape[1] + j)
                taken += n
            for step in ((a + 1, b), (a, b + 1)):
                if step[0] < len(first) and step[1] < len(second) and step not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (-(up1[first[step[0]]] + up2[second[step[1]]]), *step))
        return cells, float("-inf")


def build(points: DataFrame, sample: int = SAMPLE, codes: int | None = None) -> tuple[DataFrame, MultiIndex | None]:
    """The points with their cells, and the index.  Every row is indexed; only the codebooks come from a sample.

    The sample is of at most `sample` rows, chosen by hash.  By default a half has as many codes as the square root of
    the rows over 256, from 2 to 64, so the index that workers get is bounded.
    """
    n = points.count()
    if not n:
        return points.withColumns({"cell": F.lit(0), "part": F.lit(0)}), None
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
    limit = (1 << 30) * min(1.0, 0.8 * sample / n) if n > sample else 1 << 30
    drawn = points.where(share < int(limit)).select("vec_id", "v").limit(sample).collect()
    if not drawn:
        drawn = points.select("vec_id", "v").limit(1).collect()
    rows = matrix([bytes(r["v"]) for r in sorted(drawn, key=lambda r: (r["vec_id"], bytes(r["v"])))])
    codes = codes or int(min(64, max(2, (n / 256) ** 0.5)))
    codes = min(codes, len(rows))
    half = rows.shape[1] // 2
    books = [codebook(rows[:, :half], codes), codebook(rows[:, half:], codes)]

    @pandas_udf("i int, j int, r1 double, r2 double")
    def cells(vectors: pd.Series) -> pd.DataFrame:
        x = matrix(vectors.tolist()).astype(np.float64)
        i, j = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
        return pd.DataFrame({"i": i, "j": j, "r1": np.linalg.norm(x[:, :half] - books[0][i], axis=1), "r2": np.linalg.norm(x[:, half:] - books[1][j], axis=1)})

    placed = materialize(points.withColumn("at", cells("v")).select(*points.columns, "at.*"), "cells")
    stats = placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()
    counts, radii = np.zeros((codes, codes), np.int64), [np.zeros(codes), np.zeros(codes)]
    for r in stats:
        counts[r["i"], r["j"]] = r["n"]
        radii[0][r["i"]] = max(radii[0][r["i"]], r["r1"])
        radii[1][r["j"]] = max(radii[1][r["j"]], r["r2"])
    index = MultiIndex(books, radii, counts)
    cell = F.col("i") * codes + F.col("j")
    parts = _by_cell(index, cell)
    placed = placed.select(*points.columns, cell.alias("cell"), F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int").alias("part"))
    return placed, index


def _parts(index: MultiIndex) -> np.ndarray:
    return np.maximum(1, -(-index.counts.ravel() // PART_ROWS))


def _by_cell(index: MultiIndex, cell):
    """The number of parts of a cell, as a column."""
    return F.element_at(F.array(*[F.lit(int(n)) for n in _parts(index)]), cell + 1)


def top(score: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best valid scores of each row; columns come in the order that breaks ties."""
    if score.shape[1] > k:
        held = np.where(valid, score, LOWEST)
        least = np.partition(held, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        valid = valid & (score >= least[:, None])
    rows, cols = np.nonzero(valid)
    order = np.lexsort((cols, -score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k]


class _Part:
    """One part of a cell: distinct points in order of their ids."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.drop_duplicates(["vec_id", "label", "v"])
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.v = matrix(rows["v"].tolist())

    def search(self, anchors: pd.DataFrame, same: bool, k: int) -> Iterator[pd.DataFrame]:
        step = max(1, (2 << 20) // max(1, len(self.ids)))
        for at in range(0, len(anchors), step):
            some = anchors.iloc[at:at + step]
            v, ids, labels = matrix(some["v"].tolist()), some["vec_id"].to_numpy(), some["label"].to_numpy()
            own, windows = some["own"].to_numpy(), some["windows"].tolist()
            score = products(v, self.v)
            fits = (self.labels[None, :] == labels[:, None]) == same
            if same:
                for r, c in zip(*np.nonzero((self.ids[None, :] == ids[:, None]) & fits), strict=True):
                    fits[r, c] = not np.array_equal(self.v[c], v[r])  # a row is none of its own positives
            for nth in range(max(map(len, windows), default=0)):
                low = np.array([w[nth]["low"] if nth < len(w) else HIGHEST for w in windows])
                high = np.array([w[nth]["high"] if nth < len(w) else LOWEST for w in windows])
                number = np.array([w[nth]["w"] if nth < len(w) else -1 for w in windows])
                rows, cols = top(score, fits & (score >= low[:, None]) & (score <= high[:, None]), k)
                if len(rows):
                    yield pd.DataFrame({"own": own[rows], "w": number[rows], "score": score[rows, cols], "vec_id": self.ids[cols]})


def _visits(shared, start: int, end: int):
    @pandas_udf("cells array<int>, next double")
    def visits(vectors: pd.Series, windows: pd.Series) -> pd.DataFrame:
        found = [
            shared.value.visits(v, [(w["low"], w["high"]) for w in own], start, end)
            for v, own in zip(matrix(vectors.tolist()), windows, strict=True)
        ]
        return pd.DataFrame({"cells": [c for c, _ in found], "next": [n for _, n in found]})

    return visits


def search(anchors: DataFrame, points: DataFrame, index: MultiIndex, same: bool, k: int, first: int = 2048, growth: int = 8) -> DataFrame:
    """Rows (own, w, score, vec_id): the k best rows of each window of each anchor, of its own label or of the others.

    `anchors` has (own, vec_id, label, v, windows); a window is (w, low, high).  Every round's finds are a written
    table, so lost executors cost one round at most.
    """
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast(index)  # at most 64 codes a half and as many cells as pairs of them
    total, start, size = int(index.counts.sum()), 0, max(first, int(index.counts.sum()) // 256)
    done, live = None, anchors
    while True:
        end = start + size if start + size < total else total + 1

        at = materialize(live.withColumn("visit", _visits(shared, start, end)("v", "windows")).select(*anchors.columns, "visit.*"), "visits")
        sent = at.select("own", "vec_id", "label", "v", "windows", F.explode("cells").alias("cell"))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), _by_cell(index, F.col("cell")) - 1)))
        names = ["cell", "part", "kind", "vec_id", "label", "v", "windows", "own"]
        both = points.select("cell", "part", F.lit(0).alias("kind"), "vec_id", "label", "v", F.lit(None).cast(WINDOWS).alias("windows"), F.lit("").alias("own"))
        both = both.unionByName(sent.withColumn("kind", F.lit(1)).select(*names))
        dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "vec_id")

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, waiting, part = None, [], None
            for batch in batches:
                for own, group in batch.groupby(["cell", "part", "kind"], sort=True):
                    if own[:2] != key:
                        key, waiting, part = own[:2], [], None
                    if own[2] == 0:
                        waiting.append(group[["vec_id", "label", "v"]])
                    else:
                        if part is None and waiting:
                            part, waiting = _Part(pd.concat(waiting)), []
                        if part is not None:
                            yield from part.search(group, same, k)

        found = dealt.mapInPandas(scan, FOUND)
        if done is not None:
            found = found.unionByName(done)
        best = Window.partitionBy("own", "w").orderBy(F.col("score").desc(), "vec_id")
        done = materialize(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "found")
        start, size = end, size * growth
        if start > total:
            return done
        closed = done.groupBy("own", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        windows = at.select("own", "next", F.explode("windows").alias("x")).select("own", "next", "x.*").join(closed, ["own", "w"], "left")
        full = F.coalesce(F.col("n") >= k, F.lit(False))
        open_ = windows.where((~full | (F.col("least") <= F.col("next"))) & (F.col("next") >= F.col("low")))
        least = F.when(full, F.greatest("low", "least")).otherwise(F.col("low")).alias("low")  # what is worse is of no use
        kept = F.collect_list(F.struct("w", least, "high")).alias("windows")
        live = at.drop("windows", "cells", "next").join(open_.groupBy("own").agg(F.array_sort(kept).alias("windows")), "own").select(*anchors.columns)
        live = materialize(live, "live")
        if live.isEmpty():
            return done


def mine(points: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, codes: int | None = None) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors with ids divisible by `every`.

    An anchor's positives are the best `positives` other rows of its label; each has the best `negatives` rows of other
    labels whose score is from `low` to `high` percent of the positive's.  Higher scores come first, then smaller ids.
    Rows alike in id, label and vector count once; rows that share an id but differ otherwise are rows of their own.
    A negative positive score leaves no window.  An empty table gives no rows.
    """
    placed, index = build(points, codes=codes)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if index is None:
        nothing = placed.where(F.lit(False))
        return nothing.select(*[F.lit(None).cast("int" if n == "rank" else "long").alias(n) for n in names])
    window = F.array(F.struct(F.lit(0).alias("w"), F.lit(LOWEST).cast("long").alias("low"), F.lit(HIGHEST).cast("long").alias("high")))
    chosen = placed.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v").distinct()
    anchors = materialize(chosen.select(F.concat_ws(":", "vec_id", "label", F.md5("v")).alias("own"), "*", window.alias("windows")), "anchors")
    near = search(anchors, placed, index, True, positives).select("own", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    bounded = near.where(F.col("positive_score") >= 0).select("own", "positive_score").distinct()
    number = F.row_number().over(Window.partitionBy("own").orderBy("positive_score")).cast("int")
    bounded = materialize(bounded.select(
        "own", "positive_score", number.alias("w"),
        F.ceil(F.col("positive_score") * low / 100).alias("low"), F.floor(F.col("positive_score") * high / 100).alias("high"),
    ), "windows")
    ranges = bounded.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("windows"))
    asking = anchors.drop("windows").join(ranges, "own").select(*anchors.columns)
    far = search(asking, placed, index, False, negatives)
    rank = F.row_number().over(Window.partitionBy("own", "w").orderBy(F.col("score").desc(), "vec_id"))
    far = far.select("own", "w", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    rows = near.join(bounded, ["own", "positive_score"]).join(far, ["own", "w"]).join(anchors.select("own", F.col("vec_id").alias("anchor_id")), "own")
    return rows.select(*names)
