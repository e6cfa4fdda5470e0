"""Document fingerprints by winnowing.

Every run of `k` code points is hashed (a polynomial hash, rolled by doubling); of every window of `w` such hashes the
least is chosen, the rightmost of equal ones, and kept with its position.  Texts that share a run of w + k - 1 code
points share a fingerprint.  A text of fewer than `k` code points is one gram, one of fewer grams than `w` one window;
the empty text has no fingerprint.

The next document is found without a global sort in one task: documents are dealt into ranges of the id, sorted there,
and the first of each range is also sent, as a tail, to the range before it (that of the first range to the last).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vantage.session import local_table

BASE = np.uint64(0x9E3779B97F4A7C15)
POSITION_BITS = np.uint64(20)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of `k` codes; of the whole if there are fewer."""
    k = min(k, len(codes))
    whole, size = codes.astype(np.uint64) + np.uint64(1), 1
    power, done, rolled = int(BASE), 0, None
    while size <= k:  # runs of 1, 2, 4, ... codes, put together by the bits of k
        if k & size:
            part = whole[done:]
            if rolled is None:
                rolled = part
            else:
                n = min(len(rolled), len(part))
                rolled = rolled[:n] * np.uint64(pow(int(BASE), size, 1 << 64)) + part[:n]
            done += size
        if (size := size * 2) <= k:
            half = size // 2
            whole = whole[:-half] * np.uint64(power) + whole[half:]
            power = power * power % (1 << 64)
    return _mixed(rolled[:len(codes) - k + 1])


def winnow(text: str, k: int = 16, w: int = 32, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 32-bit hashes) of the chosen grams, in order; long texts go through in overlapping blocks."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    positions, hashes = [], []
    grams = max(len(codes) - k + 1, 1)
    for start in range(0, max(grams - w + 1, 1), block):
        hashed = gram_hashes(codes[start:start + block + w - 1 + k - 1], k) >> np.uint64(32)
        at = np.arange(len(hashed), dtype=np.uint64)
        key = (hashed << POSITION_BITS) | (((np.uint64(1) << POSITION_BITS) - np.uint64(1)) - at)  # the least hash, then the rightmost
        width, span = min(w, len(key)), 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if rest := width - span:
            key = np.minimum(key[:-rest], key[rest:])
        key = np.unique(key)
        positions.append(start + (((np.uint64(1) << POSITION_BITS) - np.uint64(1)) - (key & ((np.uint64(1) << POSITION_BITS) - np.uint64(1)))).astype(np.int64))
        hashes.append((key >> POSITION_BITS).astype(np.uint32))
    position, hashed = np.concatenate(positions), np.concatenate(hashes)
    position, first = np.unique(position, return_index=True)
    return position, hashed[first]


def packed(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """Positions and hashes, 32 bits each, in base64."""
    return base64.b64encode(np.stack([fingerprint[0].astype("<u4"), fingerprint[1].astype("<u4")], axis=1).tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(base64.b64decode(fingerprint), dtype="<u4").reshape(-1, 2)
    return both[:, 0].astype(np.int64), both[:, 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two fingerprints; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def followed(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """Rows (part, tail, doc_id, text) for :func:`fingerprints`: documents in ranges of the id and the tails."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else None
    marks = sorted(set(marks or []))
    bounds = np.array(marks, dtype=np.int64)

    @pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part(F.coalesce("doc_id", F.lit(0)))).cast("int"))
    heads = sorted((r["part"], r["least"]) for r in rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id")).alias("least")).collect())
    into = [(part, least["given"], least["doc_id"] or 0, heads[i - 1][0]) for i, (part, least) in enumerate(heads)]
    table = local_table(docs.sparkSession, into, "h_part int, given boolean, h_id long, into int")
    match = (F.col("part") == F.col("h_part")) & (F.col("doc_id").isNotNull() == F.col("given")) & (F.coalesce("doc_id", F.lit(0)) == F.col("h_id"))
    tails = rows.join(F.broadcast(table), match).select("doc_id", "text", F.col("into").alias("part"), F.lit(True).alias("tail"))
    return rows.select("doc_id", "text", "part", F.lit(False).alias("tail")).unionAll(tails)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 16, w: int = 32, ranges: int | None = None) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one per input row.

    Documents follow each other by id, then text; a null id comes first; after the last comes the first, so a single
    row is its own next.  Null text counts as empty; repeated rows follow each other; other columns are ignored; an
    empty table gives no rows.  `ranges` is the number of parts of the sorted ids (twice the shuffle partitions).
    """
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, size = None, [], 0  # (part, doc_id, text, fingerprint) still without its next

        def described(doc: tuple, after_text: str, after: tuple) -> tuple:
            _, doc_id, text, own = doc
            half = len(text) // 2
            edited = text[:len(text) - half] + after_text[:half]
            changed = winnow(edited, k, w)
            return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(own), packed(changed), likeness(own[1], changed[1]), likeness(own[1], after[1]))

        for batch in batches:
            for part, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
                own = None if tail and (before is None or before[0] != part) else winnow(text, k, w)
                if before is not None and before[0] == part:
                    out.append(described(before, text, own))
                    size += len(text)
                before = None if tail else (part, doc_id, text, own)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = followed(docs, id_col, text_col, ranges).repartition("part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select("part", "tail", "doc_id", "text").mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
