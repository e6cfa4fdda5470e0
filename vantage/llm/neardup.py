"""Near-duplicates by DartMinHash: weighted signatures, banded joining, exact checks, connected groups.

A text is the multiset of its shingles of five words (all its words if it has fewer); similarity is the weighted
Jaccard likeness, the sum of the smaller counts over the sum of the larger ones.  Two texts are linked at `threshold`
or more; a group is what links connect.

Signatures.  Every element owns one unit region per unit of weight (the last may be partial).  Darts are thrown at a
region from rank 0 upwards, with gaps, coordinates and heights taken from hashes of the region, so equal regions get
equal darts.  A text keeps, for each of the `bands * rows` coordinates, the earliest dart that lands in its regions.
Only about k (ln k + 3) darts a text are thrown, whatever its length; if a coordinate is still empty, more are.

Joining.  Texts with equal words are one representative from the start.  Texts share a bucket if they agree on all rows
of a band.  In each bucket the member that meets most others is compared with the rest, exactly; links are contracted.
What is left are strays, members outside their bucket's largest group.  They are compared with all members of other
groups, exactly: in small buckets pair by pair, each pair once, in large ones block by block with matrix products that
give back only links which connect something.  No pair of a bucket is left out, and no pairs of a group are emitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vantage.llm.common import WORD
from vantage.session import materialize

WORDS = re.compile(WORD)
M1, M2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode())
        return value


class Shingler:
    """Shingle hashes of texts, each with its count."""

    def __init__(self, size: int = 5, keep: int = 500_000):
        self.size, self.keep, self.known = size, keep, WordHash()

    def words(self, text: str | None) -> list[str]:
        return WORDS.findall(text.lower()) if text else []

    def shingles(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, np.uint64), np.empty(0)
        if len(self.known) > self.keep:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        rolled = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            rolled = mix(rolled * STEP + h[i:len(h) - n + 1 + i])
        return np.unique(rolled, return_counts=True)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, texts: np.ndarray, count: int, k: int) -> np.ndarray:
    """Earliest ranks, `count` x `k`, of the sets given by (element, weight, text number); equal ranks are equal darts.

    Texts without elements keep infinite ranks.
    """
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    height = np.minimum(weights[owner] - cell, 1.0)
    region = mix(elements[owner] + mix(cell.astype(np.uint64) * STEP))
    text = texts[owner]
    total = np.bincount(text, height, count)
    limit = np.where(total > 0, (np.log(k) + 3) / np.maximum(total, 1e-9), 0.0)
    ranks = np.full(count * k, np.inf)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        pending = np.zeros(count, bool)
        pending[todo] = True
        live = np.flatnonzero(pending[text])
        at, thrown, block = np.zeros(len(live)), 0, 4
        while len(live):
            numbers = np.arange(thrown, thrown + block, dtype=np.uint64) * STEP
            dart = mix(region[live][:, None] + numbers[None, :])
            gap = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / k
            gap[:, 0] += at
            rank = np.cumsum(gap, axis=1)
            other = mix(dart ^ STEP)
            own = text[live]
            good = rank < limit[own][:, None]
            partial = height[live] < 1
            if partial.any():
                good &= ~partial[:, None] | ((mix(other) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < height[live][:, None])
            spot = own[:, None] * k + (other % np.uint64(k)).astype(np.int64)
            np.minimum.at(ranks, spot[good], rank[good])
            on = rank[:, -1] < limit[own]
            live, at, thrown, block = live[on], rank[on, -1], thrown + block, min(2 * block, 64)
        todo = todo[~np.isfinite(ranks.reshape(count, k)[todo]).all(axis=1)]
        limit[todo] *= 2
    return ranks.reshape(count, k)


def bands_of(ranks: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key a band."""
    bits = np.ascontiguousarray(ranks).view(np.uint64).reshape(len(ranks), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * STEP), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = mix(key * STEP + bits[:, :, i])
    return key.view(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two counted sets; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / high) if (high := a[1].sum() + b[1].sum() - low) else 0.0


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """Rows (doc_id, text_key, words_key, n, buckets): text digest, digest of the words (of a text without words the text itself; null if null or empty), number of shingles."""

    @pandas_udf("words_key binary, n long, buckets array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(size)
        for texts in batches:
            out = []
            for start in range(0, len(texts), 256):
                listed = [shingler.words(t) for t in texts.iloc[start:start + 256]]
                sets = [shingler.shingles(w) for w in listed]
                number = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
                ranks = dart_minhash(np.concatenate([e for e, _ in sets]), np.concatenate([c for _, c in sets]).astype(float), number, len(sets), bands * rows)
                keys = [xxhash.xxh128_digest((" ".join(w) if w else f"\0{t}").encode()) if t else None for t, w in zip(texts.iloc[start:start + 256], listed, strict=True)]
                out.append(pd.DataFrame({"words_key": keys, "n": [int(c.sum()) for _, c in sets], "buckets": list(bands_of(ranks, bands))}))
            yield pd.concat(out) if out else pd.DataFrame({"words_key": [], "n": [], "buckets": []})

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_col, 256).alias("text_key"), sign(F.col(text_col)).alias("s")
    ).select("doc_id", "text_key", "s.*")


def connected(edges: DataFrame) -> DataFrame:
    """Rows (id, root) for the nodes of (u, v) that are connected with a lesser one: the least such.  Alternating large and small stars.

    Joins and minima only, so a node with any number of links needs no task of its own; every round is written.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def key(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = key(edges)
    while before[0]:
        around = both(edges)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "small")
        after = key(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")


def unit_sets(texts: DataFrame, size: int) -> DataFrame:
    """Rows (id, units) of (id, text): hashes of the counted shingles, the second of a kind another one than the first, sorted."""

    @pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(size)
        for batch in batches:
            yield pd.Series([units(*shingler.shingles(shingler.words(t))) for t in batch], dtype=object)

    return texts.select("id", run("text").alias("units"))


def units(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.int64)
    cell = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(mix(np.repeat(elements, counts) + mix(cell.astype(np.uint64) * STEP)).view(np.int64))


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (u, v) that are links, with `similarity`."""

    @pandas_udf("double")
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            same = (len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(left, right, strict=True))
            yield pd.Series([n / (len(a) + len(b) - n) for n, a, b in zip(same, left, right, strict=True)], dtype="float64")

    left, right = sets.select(F.col("id").alias("u"), F.col("units").alias("a")), sets.select(F.col("id").alias("v"), F.col("units").alias("b"))
    found = pairs.join(right, "v").join(left, "u").withColumn("similarity", similarity("a", "b"))
    return found.where(F.col("similarity") >= threshold).select("u", "v", "similarity")


def block_links(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], stray: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links of the stray rows with all rows of other groups: exact, by products of incidence matrices of the shared units.

    Only links that connect something new are returned, so at most one a row.
    """
    sizes = np.array([len(x) for x in sets])
    row, unit = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, column, held = np.unique(unit, return_inverse=True, return_counts=True)
    shared = np.cumsum(held > 1) - 1
    keep = held[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    strays = np.flatnonzero(stray)
    same = np.zeros((len(strays), len(sets)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, columns, 2048):
        part = slice(np.searchsorted(column, start), np.searchsorted(column, start + 2048))
        matrix = np.zeros((len(sets), min(2048, columns - start)), np.float32)
        matrix[row[part], column[part] - start] = 1
        same += matrix[strays] @ matrix.T
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for start in range(0, len(strays), 256):  # a strip of strays at a time, so that the wide temporaries stay small
        strip = strays[start:start + 256]
        likely = same[start:start + 256] / (sizes[strip][:, None] + sizes[None, :] - same[start:start + 256])
        for i, j in zip(*np.nonzero(likely >= threshold), strict=True):
            a, b = top(int(roots[strip[i]])), top(int(roots[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[strip[i]]), int(ids[j]), float(likely[i, j])))
    return out


def _dealt(open_rows: DataFrame, block: int, height: int) -> DataFrame:
    """Rows (bucket, id, root, i, j, stray): the strays of part i and the members of part j, parts of about `block` units and `height` rows at most."""
    parts = open_rows.groupBy("bucket").agg(F.greatest(F.sum("n") / block, F.count(F.lit(1)) / height).cast("int").alias("parts"))
    rows = open_rows.join(parts, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts") + 1))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long"))
    strays = rows.where("stray").select("bucket", "id", "root", F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("stray"))
    others = rows.select("bucket", "id", "root", F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(False).alias("stray"))
    return strays.unionAll(others)


def _blocks(open_rows: DataFrame, sets: DataFrame, threshold: float, block: int, height: int) -> DataFrame:
    """Links in the large open buckets, each pair of parts one task's group: 4 bytes for each of its strays and rows, some 70 MB with the product."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        found = block_links(frame["id"].to_numpy(), frame["root"].to_numpy(), frame["units"].tolist(), frame["stray"].to_numpy(), threshold)
        return pd.DataFrame(found, columns=["u", "v", "similarity"])

    return _dealt(open_rows, block, height).join(sets, "id").groupBy("bucket", "i", "j").applyInPandas(find, "u long, v long, similarity double")


def links(members: DataFrame, sets: DataFrame, threshold: float, small: int = 16, block: int = 200_000, height: int = 2000) -> DataFrame:
    """All links found, rows (u, v, similarity): enough of them to connect every group.

    `members` has (bucket, id, n, size) for buckets of two texts or more, `sets` (id, units).
    """
    fits = f"least(u_n, n) >= {threshold} * greatest(u_n, n)"  # no likeness above the ratio of the sizes
    meets = members.groupBy("id").agg(F.sum("size").alias("met"))
    first = members.join(meets, "id").groupBy("bucket").agg(F.max_by(F.struct(F.col("id").alias("u"), F.col("n").alias("u_n")), F.struct("met", -F.col("id"))).alias("lead"))
    pairs = members.join(first.select("bucket", "lead.*"), "bucket").where("id <> u").where(fits).select("u", F.col("id").alias("v")).distinct()
    found = materialize(_compared(pairs, sets, threshold), "links")

    rooted = members.where("size > 2").join(connected(found.select("u", "v")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    counted = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("here"))
    main = counted.groupBy("bucket").agg(F.max_by("root", F.struct("here", -F.col("root"))).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    rows = materialize(rooted.join(main, "bucket").withColumn("stray", F.col("root") != F.col("main")), "open")
    few = rows.where(F.col("size") <= small)
    strays = few.where("stray").select("bucket", F.col("id").alias("u"), F.col("n").alias("u_n"), F.col("root").alias("u_root"))
    pairs = few.join(strays, "bucket").where(f"root <> u_root and (not stray or id < u) and {fits}").select("u", F.col("id").alias("v")).distinct()
    more = _compared(pairs, sets, threshold).unionAll(_blocks(rows.where(F.col("size") > small), sets, threshold, block, height))
    return found.unionAll(materialize(more, "links"))


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 6,
) -> DataFrame:
    """Rows (doc_id, text_key, class_id, class_key), one per input row: `class_id` is the least id of the group, `class_key`
    the text key of the row that stands for it (of that id; the least key if the id repeats).

    A link of likeness 0.8 shares no band with probability 6e-6 at 40 bands of 6 rows, a likelier one less.  Null and
    empty texts are linked with nothing: their class is their own id; texts without words only with equal texts.  Links
    are between texts, so rows that share an id but not a text may be in different groups.  Repeated rows and equal
    texts are one group; null ids stay, with a null class unless their text has a group; an empty table gives no rows;
    other columns are ignored.
    """
    signed = materialize(signatures(docs, id_col, text_col, size, bands, rows), "signed")
    firsts = (
        signed.where("words_key is not null and doc_id is not null").groupBy("words_key")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    )
    # a number for each text, settled when the table is written
    firsts = materialize(firsts.select("words_key", "first.doc_id", "first.text_key", "n", "buckets", F.monotonically_increasing_id().alias("id")), "firsts")
    all_members = firsts.where("n > 0").select(F.explode("buckets").alias("bucket"), "id", "n")
    full = all_members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(all_members.join(full, "bucket"), "members")
    due = members.select("id").distinct().join(firsts.select("id", "doc_id", "text_key"), "id")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = text.join(due, "doc_id").where(F.sha2("text", 256) == F.col("text_key")).select("id", "text")
    sets = materialize(unit_sets(own, size).dropDuplicates(["id"]), "sets")
    roots = connected(links(members, sets, threshold).select("u", "v"))
    rooted = firsts.select("words_key", "id", F.struct("doc_id", "text_key").alias("first")).join(roots, "id", "left")
    rooted = materialize(rooted.select("words_key", F.coalesce("root", "id").alias("root"), "first"), "rooted")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    classes = rooted.join(heads, "root").select("words_key", "head")
    found = signed.select("doc_id", "text_key", "words_key").join(classes, "words_key", "left")
    return found.select("doc_id", "text_key", F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.coalesce("head.text_key", "text_key").alias("class_key"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One whole row of each group, that which stands for it, all columns; rows without text or id all stay."""
    found = groups(docs, id_col, text_col, **options)
    gone = found.where("doc_id is not null and (class_id <> doc_id or class_key <> text_key)").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col("gone_id")) & F.sha2(text_col, 256).eqNullSafe(F.col("gone_key")), "left_anti")
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return left.withColumn(key, F.when(F.col(text_col).isNull() | F.col(id_col).isNull(), F.monotonically_increasing_id().cast("string")).otherwise(F.sha2(text_col, 256))).dropDuplicates([id_col, key]).drop(key)
