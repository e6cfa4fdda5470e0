"""Packing documents into windows of equal length by minimum bin slack.

A document's ids are cut into whole windows and a rest.  How many rests there are of each length is all that choosing
needs: at most `window` counts, whatever the size of the corpus.  For the longest length left, a subset sum over a
bitset (one bit a sum, bundles of 1, 2, 4 ... equal lengths) finds the sum that comes closest to the room that is left;
going back through the bundles gives how often each length is used.  The same choice is repeated for as many windows
as the counts allow.  Where slack stays, the front of one more rest fills it and its back goes among the lengths
left; a last, unfilled window is cut at powers of two, which need no padding.

The choice is a table of slots (length, ranks, place).  Pieces are numbered within their length, in parts by hash, so
that a length that a third of the documents share is no single task, and meet their slots in a broadcast join.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vantage.llm.bpe import shared_codec
from vantage.session import local_table, materialize

WINDOW = 2048
PARTS = 1024
SLOT = (
    "slot_size long, low long, high long, slot_start long, slot_length long, first_sequence long, shift long, copies long, slot_offset long"
)


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length, at most as often as it occurs, so that the sum comes closest to `room` from below."""
    reach, full, bundles = 1, (1 << (room + 1)) - 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, bundle = min(counts[size], room // size), 1
        while left and not reach >> room & 1:
            bundle = min(bundle, left)
            bundles.append((size, bundle, reach))
            reach |= (reach << (size * bundle)) & full
            left, bundle = left - bundle, 2 * bundle
    rest, used = reach.bit_length() - 1, Counter()
    for size, bundle, before in reversed(bundles):
        if not before >> rest & 1:
            used[size] += bundle
            rest -= size * bundle
    return dict(used)


class Rests:
    """Lengths that wait for a window: for each the ranks of the pieces that have it, whole or without a cut front."""

    def __init__(self, counts: dict[int, int]):
        self.left = {size: n for size, n in counts.items() if n}
        self.lots = defaultdict(deque, {size: deque([(size, 0, n, 0)]) for size, n in self.left.items()})

    def take(self, size: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """`n` pieces of that length, as (length of the whole piece, first rank, end of ranks, start in the piece)."""
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
        while n:
            whole, low, high, start = self.lots[size].popleft()
            end = min(high, low + n)
            if end < high:
                self.lots[size].appendleft((whole, end, high, start))
            yield whole, low, end, start
            n -= end - low

    def put(self, size: int, lots: list[tuple[int, int, int, int]]) -> None:
        for lot in lots:
            self.left[size] = self.left.get(size, 0) + lot[2] - lot[1]
            self.lots[size].append(lot)


def slots(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, ...]]:
    """Where pieces go: for ranks low to high of a length, the part of `slot_length` ids from `slot_start` on.

    The piece of rank r is number j = r - low + shift of its slots; it stands in sequence first_sequence + j // copies,
    at slot_offset + j % copies * slot_length.  Every part of every piece is in exactly one row.  A round empties a
    length or cuts all pieces that it can, so rows are bounded by the lengths, not by the documents.
    """
    rests, rows, sequence = Rests(counts), [], 0
    while rests.left:
        seed = max(rests.left)
        others = dict(rests.left)
        others[seed] -= 1
        used = Counter(closest({s: n for s, n in others.items() if n}, window - seed))
        used[seed] += 1
        slack = window - sum(s * n for s, n in used.items())
        times, cut = min(rests.left[s] // n for s, n in used.items()), 0
        if slack:  # the most windows that one more piece of some length can fill; no length left is so short as the slack
            times, cut = max((min(times, n // (used[s] + 1)), s) for s, n in rests.left.items())
            if not times:
                rows += _last(rests, used, sequence)
                break
        offset = 0
        for size, copies in sorted(used.items(), reverse=True):
            shift = 0
            for whole, low, high, start in rests.take(size, times * copies):
                rows.append((whole, low, high, start, size, sequence, shift, copies, offset))
                shift += high - low
            offset += size * copies
        if slack:
            shift, backs = 0, []
            for whole, low, high, start in rests.take(cut, times):
                rows.append((whole, low, high, start, slack, sequence, shift, 1, offset))
                shift += high - low
                backs.append((whole, low, high, start + slack))
            rests.put(cut - slack, backs)
        sequence += times
    return rows


def _last(rests: Rests, used: dict[int, int], sequence: int) -> list[tuple[int, ...]]:
    """The pieces of a window that stays unfilled, in sequences of falling powers of two."""
    total, rows = sum(s * n for s, n in used.items()), []
    room = 1 << (total.bit_length() - 1)
    offset = 0
    for size, copies in sorted(used.items(), reverse=True):
        for whole, low, high, start in list(rests.take(size, copies)):
            for rank in range(low, high):
                done = 0
                while done < size:
                    length = min(size - done, room - offset)
                    rows.append((whole, rank, rank + 1, start + done, length, sequence, 0, 1, offset))
                    done, offset, total = done + length, offset + length, total - length
                    if offset == room:
                        sequence, offset, room = sequence + 1, 0, 1 << max(total.bit_length() - 1, 0)
    return rows


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, doc_tokens, start, size, packed): every document's ids and `end_id`, in pieces of at most `window`.

    `packed` holds the ids in two bytes each where the vocabulary allows it, else in four.
    """
    width = _width(path)

    @pandas_udf("tokens long, parts array<binary>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = shared_codec(path)
        for texts in batches:
            rows = []
            for ids in codec.encode_all(texts.tolist()):
                raw = np.append(ids, end_id).astype(f"<u{width}").tobytes()
                rows.append((len(ids) + 1, [raw[i:i + width * window] for i in range(0, len(raw), width * window)]))
            yield pd.DataFrame(rows, columns=["tokens", "parts"])

    rows = docs.select(F.col(id_col).alias("doc_id"), cut(F.coalesce(F.col(text_col), F.lit(""))).alias("cut"))
    rows = rows.select("doc_id", F.col("cut.tokens").alias("doc_tokens"), F.posexplode("cut.parts").alias("at", "packed"))
    size = (F.octet_length("packed") / width).cast("long")
    return rows.select("doc_id", "doc_tokens", (F.col("at").cast("long") * window).alias("start"), size.alias("size"), "packed")


def _width(path: str) -> int:
    """Bytes that hold any id of the vocabulary."""
    return 2 if len(shared_codec(path).token_size) <= 1 << 16 else 4


def _ranked(rows: DataFrame) -> DataFrame:
    """Pieces with gapless ranks from 0 within their size: ranks in a part by hash, and the counts of the parts before."""
    order = ["doc_id", "start", "doc_tokens", "digest"]
    rows = rows.withColumn("digest", F.xxhash64("packed")).withColumn("part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    counts = rows.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("before")
    counts = counts.select("size", "part", before)
    inside = F.row_number().over(Window.partitionBy("size", "part").orderBy(*order)) - 1
    return rows.join(counts, ["size", "part"]).withColumn("rank", F.col("before") + inside).drop("part", "before", "digest")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset), one per piece of a document.

    `ids` are the piece's ids as little-endian 32-bit integers, `start` counts the document's ids before it, `offset`
    the ids before it in its sequence.  Null text counts as empty and is the end id alone; null ids and repeated rows
    are packed like others; rows alike in id, start and ids may swap places; other columns are ignored; an empty table
    gives no rows.  A text of any length is one row until its ids are cut.
    """
    spark = docs.sparkSession
    rows = materialize(pieces(docs, path, window, end_id, id_col, text_col), "pieces")
    counts = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    places = F.broadcast(slot_table(spark, counts, window))
    near = (F.col("size") == F.col("slot_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    width = _width(path)
    number = F.col("rank") - F.col("low") + F.col("shift")
    part = F.substring("packed", (F.col("slot_start") * width + 1).cast("int"), (F.col("slot_length") * width).cast("int"))

    @pandas_udf("binary")
    def widened(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p, f"<u{width}").astype("<u4").tobytes() for p in packed], dtype=object)

    return _ranked(rows).join(places, near).select(
        "doc_id", (F.col("start") + F.col("slot_start")).alias("start"), F.col("slot_length").alias("length"), widened(part).alias("ids"),
        "doc_tokens", (F.col("first_sequence") + F.floor(number / F.col("copies"))).alias("sequence_id"),
        (F.col("slot_offset") + number % F.col("copies") * F.col("slot_length")).alias("offset"),
    )


def slot_table(spark: SparkSession, counts: dict[int, int], window: int = WINDOW) -> DataFrame:
    return local_table(spark, slots(counts, window), SLOT)


def digests(docs: DataFrame, path: str, **options) -> DataFrame:
    """As `pack`, with CRC-32 of the ids in place of the ids."""
    rows = pack(docs, path, **options)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, n_tokens, ids): the packed pieces joined in order, at most a window of them each."""
    piece = F.struct("offset", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return rows.select("sequence_id", "n_tokens", F.aggregate("pieces", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
