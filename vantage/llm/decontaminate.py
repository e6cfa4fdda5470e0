"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `size` consecutive words of an item (all its words if it has fewer).  Its tokens are its shingles of three
words with their offsets.  A document holds the window only if it holds every shingle, so one necessary prefix token
is enough to find all candidates: the shingle that is rarest in the whole corpus.  A candidate must pass the positional
and length bounds (the window starts at or after the first word and ends at or before the last) and is then compared
word for word.  All of it is DataFrame expressions; documents are tokenised twice, never shuffled.

Only item windows are broadcast, in blocks of at most `block_bytes`; a larger benchmark takes more passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import text_key, words
from vantage.session import materialize

SHINGLE = 3


def _shingle(array: str, at: Column | int, size: int = SHINGLE) -> Column:
    """Key of `size` words of `array` from `at`; words beyond the end add nothing."""
    return F.xxhash64(*[F.get(array, F.lit(at) + i) for i in range(size)])


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """Distinct windows (window, items, width); items are ids as text, a null id the empty text."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return (
        items.withColumn("start", F.explode(starts))
        .select("item", F.slice("words", F.col("start") + 1, F.lit(size)).alias("window"))
        .groupBy("window").agg(F.collect_set("item").alias("items"))
        .withColumn("width", F.least(F.size("window"), F.lit(SHINGLE)))
    )


def _blocks(df: DataFrame, key: str, row_bytes: Column, block_bytes: int) -> list[DataFrame]:
    """`df` cut by the hash of `key` into parts that may be broadcast."""
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    n = int(total) // block_bytes + 1
    return [df.where(F.pmod(F.hash(key), F.lit(n)) == i) if n > 1 else df for i in range(n)]


def _tokens(docs: DataFrame, widths: list[int]) -> DataFrame:
    """One row per word position (first row of a text: position 0, without a key), with the keys that start there."""
    spread = docs.select("*", F.posexplode("w").alias("pos", "word"))
    keys = [_shingle("w", F.col("pos"), k) for k in widths]
    if len(keys) == 1:
        return spread.withColumn("key", F.when(F.col("pos") > 0, keys[0]))
    none = F.array(F.lit(None).cast("long"))
    return spread.withColumn("key", F.explode(F.when(F.col("pos") > 0, F.array(*keys)).otherwise(none)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"),
        F.concat(F.array(F.lit("")), words(F.col(text_col))).alias("w"),
    )


def prefix_tokens(docs: DataFrame, windows: DataFrame, block_bytes: int) -> DataFrame:
    """Each window that can occur, with its rarest shingle (key, offset); windows with an absent shingle go."""
    shingles = windows.select(
        "window", "items", "width",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.size("window") - F.col("width")), lambda i: _shingle("window", i))).alias("offset", "key"),
    )
    widths = [r[0] for r in windows.select("width").distinct().collect()] or [SHINGLE]
    texts = docs.select("w")
    counts = [
        _tokens(texts, widths).select("key").join(F.broadcast(block), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        for block in _blocks(shingles.select("key").distinct(), "key", F.lit(16), block_bytes)
    ]
    ranked = shingles.join(reduce(DataFrame.unionAll, counts), "key", "left")
    return ranked.groupBy("window").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by(F.struct("key", "offset"), F.struct(F.coalesce("n", F.lit(0)), "offset")).alias("rarest"),
        F.first("items").alias("items"), F.first("width").alias("width"),
    ).where("least > 0").select("rarest.key", "rarest.offset", "window", "items", "width")


def window_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = 10, block_bytes: int = 32 << 20,
) -> DataFrame:
    """Rows (doc_id, text_key, copies, n_words, spans, items): one per id and text, `copies` rows of the input each.

    `spans` are the (first, last) word positions from 1 of occurring windows, `items` the ids of their items.  Null and
    empty texts have no words and no spans; null ids stay; repeated rows count as copies; other columns are ignored;
    an empty benchmark hits nothing.
    """
    windows = materialize(item_windows(benchmark, item_col, item_text_col, size), "windows")
    texts = _texts(docs, id_col, text_col)
    probes = materialize(prefix_tokens(texts, windows, block_bytes), "prefixes")
    widths = [r[0] for r in probes.select("width").distinct().collect()] or [SHINGLE]
    row_bytes = F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * (F.size("window") + F.size("items")) + 64
    parts = []
    for i, block in enumerate(_blocks(probes, "window", row_bytes, block_bytes)):
        block = block.select(F.col("key").alias("probe"), "offset", "window", "items", F.size("window").alias("length"))
        first = F.col("pos") - F.col("offset")
        found = _tokens(texts.withColumn("n_words", F.size("w") - 1), widths).join(
            F.broadcast(block),
            (F.col("key") == F.col("probe")) & (first > 0) & (first + F.col("length") - 1 <= F.col("n_words"))
            & (F.slice("w", F.greatest(first, F.lit(0)) + 1, F.col("length")) == F.col("window")),
            "left",
        )
        start = F.col("pos") == 0
        parts.append(found.where(start | F.col("offset").isNotNull()).select(
            "doc_id", "text_key", "n_words", (start & F.lit(i == 0)).cast("long").alias("row"),
            F.when(F.col("offset").isNotNull(), F.struct(first.alias("first"), (first + F.col("length") - 1).alias("last"))).alias("span"), "items",
        ))
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id", "text_key").agg(
        F.sum("row").alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.collect_set("span").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def hit_words(spans: str) -> Column:
    """Number of word positions that the spans cover."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        F.array_sort(spans), state,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["last"] - F.greatest(s["first"] - 1, a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["last"]).alias("upto"),
        ),
        lambda a: a["n"],
    )


def report(hits: DataFrame) -> DataFrame:
    """One row per input row: word counts, items and their digest."""
    return hits.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "n_words", hit_words("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which no window occurs, whole rows, all columns."""
    hits = window_hits(docs, benchmark, id_col, text_col, **options).where(F.size("spans") > 0)
    bad = hits.select(F.col("doc_id").alias("bad_doc_id"), F.col("text_key").alias("bad_text_key"))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("bad_doc_id")) & (text_key(F.col(text_col)) == F.col("bad_text_key")), "left_anti")
