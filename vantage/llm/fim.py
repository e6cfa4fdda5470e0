"""Fill-in-middle transformation over a compressed set of token boundaries.

A text's tokens are runs of the letters A-Z and every other character alone.  The places where they begin and end are a
set of numbers, kept in containers of 65,536 places: a sorted array, a bitmap or a list of runs, whichever is smallest.
Counts before each container lead to the one that holds the k-th boundary, and a select inside it gives the place, so
both cuts of a text come from two lookups.  The text is read a container's width at a time; cutting, joining and
rebuilding are column expressions on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SPAN = 1 << 16

#: Marks before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class ArrayContainer:
    """Places in order, two bytes each."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class BitmapContainer:
    """A bit a place, with the number of bits before every word of 64."""

    def __init__(self, places: np.ndarray):
        bits = np.zeros(SPAN, dtype=bool)
        bits[places] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        each = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(each) - each

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            bits &= bits - 1  # without its lowest bit
        return 64 * word + (bits & -bits).bit_length() - 1


class RunContainer:
    """First place of every run of neighbours, with the number of places before it."""

    def __init__(self, places: np.ndarray):
        first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        self.starts, self.before = places[first].astype(np.uint16), first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(places: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three for places below 65,536 in order: 2 bytes a place, 4 a run, 8,192 for a bitmap."""
    runs = 1 + int(np.count_nonzero(np.diff(places) != 1))
    sizes = {ArrayContainer: 2 * len(places), RunContainer: 4 * runs, BitmapContainer: SPAN // 8}
    return min(sizes, key=sizes.get)(places)


class BoundarySet:
    """Numbers added in ascending blocks, found again by their rank."""

    def __init__(self):
        self.highs: list[int] = []
        self.containers: list = []
        self.before = [0]

    def add(self, high: int, places: np.ndarray) -> None:
        """The numbers 65,536 * high + places; `high` ascends from call to call."""
        if len(places):
            self.highs.append(high)
            self.containers.append(container(places))
            self.before.append(self.before[-1] + len(places))

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """The k-th smallest number, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return SPAN * self.highs[at] + self.containers[at].select(k - self.before[at])


def boundaries(text: str) -> BoundarySet:
    """Where tokens begin, and the end of the text: one more than there are tokens (the empty text has place 0 alone)."""
    found, letter_before = BoundarySet(), False
    for high, start in enumerate(range(0, len(text) + 1, SPAN)):
        codes = np.frombuffer(text[start:start + SPAN].encode("utf-32-le"), np.uint32)
        letter = ((codes | 32) - np.uint32(97)) < 26
        inside = letter & np.concatenate([[letter_before], letter[:-1]])
        places = np.flatnonzero(~inside)
        if start + len(codes) == len(text) and len(codes) < SPAN:
            places = np.append(places, len(codes))
        found.add(high, places)
        letter_before = bool(letter[-1]) if len(letter) else letter_before
    return found


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Tokens n, and the two places behind the smaller and the larger of first % (n + 1) and second % (n + 1) tokens."""
    found = boundaries(text)
    low, high = sorted((first % len(found), second % len(found)))
    return len(found) - 1, found.select(low), found.select(high)


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, first, second in batches:
        rows = [cuts(*r) for r in zip(texts, first.tolist(), second.tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=["n", "low", "high"])


def restored(output: Column, form: Column) -> Column:
    """The text from a transformed one.  No mark stands in a transformed text but the three, so the first hit is the cut."""

    def rebuilt(mark: str, prefix_first: bool) -> Column:
        at = F.instr(output, mark)
        rest = output.substr(at + 3, F.char_length(output))
        end = F.instr(rest, MIDDLE)
        one, two, middle = output.substr(F.lit(4), at - 4), rest.substr(F.lit(1), end - 1), rest.substr(end + 3, F.char_length(rest))
        return F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one)

    return F.when(form == "psm", rebuilt(SUFFIX, True)).when(form == "spm", rebuilt(PREFIX, False)).otherwise(output)


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", share: int = 90, swapped: int = 20
) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output, restored), one per input row.

    Four numbers from SHA-256 of "seed:doc_id" decide: two give the cuts in tokens, the third leaves 100 - `share`
    percent of the texts plain, the fourth puts the suffix first in `swapped` percent.  Null text counts as empty, a
    null id as the word null; empty texts and those that hold a mark stay plain, and their counts of characters are
    null.  Repeated rows stay and come out alike; other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = (
        F.when((F.col("text") == "") | marked | (h[2] % 100 >= share), "plain")
        .when(h[3] % 100 < swapped, "spm").otherwise("psm")
    )
    rows = rows.select("doc_id", "text", form.alias("form"), pandas_udf(_cuts, "n long, low long, high long")("text", h[0], h[1]).alias("cut"))
    low, high = F.col("cut.low"), F.col("cut.high")
    prefix, middle = F.col("text").substr(F.lit(1), low), F.col("text").substr(low + 1, high - low)
    suffix = F.col("text").substr(high + 1, F.char_length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(cut, low).alias("prefix_chars"), F.when(cut, high - low).alias("middle_chars"),
        output.alias("output"),
    ).withColumn("restored", restored(F.col("output"), F.col("form")))


def digests(docs: DataFrame, **options) -> DataFrame:
    """As `transform`, with SHA-256 of the output and of the text rebuilt from it."""
    rows = transform(docs, **options)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
