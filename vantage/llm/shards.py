"""Sharding by balanced label propagation.

Documents with equal texts are linked (a star through the text's key, never pairs).  Documents of one text in one shard
are interchangeable, so a group is one row: its key and how many of its members are in each shard, however large it is.
The start cuts all linked documents, in the order of their groups' hashes, into equal ranges, which keeps every quota even
where there is no unlinked document to make room.  In each round the members of a group that is in several shards wish to
join the shard with room where most of the group already is; the wishes are joined with the room that is left and granted
up to it, in exact running order, the largest first.  Rounds go on while they keep more links whole.  Unlinked documents
have no edges: they fill what is left, so that the law `rows` holds exactly: shard s gets floor(N / shards) documents, one
more if s < N mod shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.session import materialize

LANES = 4096
SALTS = 1024


def _ahead(df: DataFrame, keys: Sequence[str], value: str, name: str, rank: Column | None = None, lanes: int = LANES) -> DataFrame:
    """The sum of `value` over the rows before each one within `keys`, without a task per key.

    Rows are dealt to lanes by `rank` (0 to 63, first if lower) and the hash of the group; the totals of the lanes, at
    most `lanes` a key and rank, are summed and joined to running sums inside a lane.
    """
    lane = F.pmod(F.xxhash64("grp"), F.lit(lanes)).cast("int")
    rows = df.withColumn("lane", lane if rank is None else rank * lanes + lane)
    by = [*keys, "lane"]
    totals = rows.groupBy(*by).agg(F.sum(value).alias("sum")).select(
        *by, (F.sum("sum").over(Window.partitionBy(*keys).orderBy("lane")) - F.col("sum")).alias("before")
    )
    inside = F.sum(value).over(Window.partitionBy(*by).orderBy(F.desc(value), "grp").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("inside", inside - F.col(value)).join(F.broadcast(totals), by).withColumn(name, F.col("before") + F.col("inside")).drop("lane", "inside", "before")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, n: total + n)


def _ranges(groups: DataFrame, shards: int) -> DataFrame:
    """The start: (grp, counts) with the members of all groups, one group after the other, cut into equal ranges."""
    linked = groups.agg(F.sum("members")).first()[0] or 0
    cuts = [s * (linked // shards) + min(s, linked % shards) for s in range(shards + 1)]
    ahead, upto = F.col("ahead"), F.col("ahead") + F.col("members")
    counts = [F.greatest(F.least(upto, F.lit(high)) - F.greatest(ahead, F.lit(low)), F.lit(0)).cast("long") for low, high in zip(cuts, cuts[1:])]
    return _ahead(groups, [], "members", "ahead").select("grp", F.array(*counts).alias("counts"))


def _wishes(state: DataFrame, free: list[int]) -> DataFrame:
    """With `to` (the best shard that has room), `moves` (members that would leave each shard for it) and their sum `wish`."""
    room = F.array(*[F.lit(max(n, 0)).cast("long") for n in free])

    def pull(n: Column, s: Column) -> Column:
        return F.struct(n.alias("n"), F.xxhash64("grp", s).alias("tie"), s.alias("s"))

    pulls = state.withColumn("room", room).withColumn("pulls", F.transform("counts", pull))
    best = pulls.withColumn("best", F.array_max(F.filter("pulls", lambda p: F.get("room", p["s"]) > 0)))
    moves = best.withColumn("moves", F.transform("pulls", lambda p: F.when(p < F.col("best"), p["n"]).otherwise(F.lit(0).cast("long"))))
    return moves.select("grp", "counts", F.col("best.s").alias("to"), "moves", _sum(F.col("moves")).alias("wish"), F.get("room", F.col("best.s")).alias("free"))


def _round(state: DataFrame, free: list[int]) -> DataFrame:
    """One round of propagation over (grp, counts)."""
    wishes = _wishes(state, free)
    moving = F.coalesce(F.col("wish") > 0, F.lit(False))
    asked = _ahead(wishes.where(moving), ["to"], "wish", "ahead", rank=63 - F.floor(F.log2("wish")).cast("int"), lanes=128)
    granted = asked.withColumn("granted", F.greatest(F.least("wish", F.col("free") - F.col("ahead")), F.lit(0).cast("long")))

    def after(n: Column, s: Column) -> Column:
        left = F.greatest(F.col("granted") - _sum(F.slice("moves", 1, s)), F.lit(0).cast("long"))
        return n - F.least(F.get("moves", s), left) + F.when(s == F.col("to"), F.col("granted")).otherwise(F.lit(0))

    return wishes.where(~moving).select("grp", "counts").unionAll(granted.select("grp", F.transform("counts", after).alias("counts")))


def _held(state: DataFrame, shards: int) -> tuple[list[int], float]:
    """How many linked documents each shard holds, and the links kept whole: ordered pairs of linked documents in one shard."""
    whole = F.aggregate("counts", F.lit(0.0), lambda total, n: total + n.cast("double") * n)
    row = state.agg(*[F.sum(F.get("counts", F.lit(s))) for s in range(shards)], F.sum(whole)).first()
    return [n or 0 for n in row[:shards]], row[shards] or 0.0


def propagate(state: DataFrame, quotas: list[int], rounds: int = 16) -> tuple[DataFrame, list[int]]:
    """Rounds while they keep more links whole, each written to the shared folder; and what every shard then holds."""
    state = materialize(state, "labels")
    held, kept = _held(state, len(quotas))
    for _ in range(rounds):
        after = materialize(_round(state, [q - h for q, h in zip(quotas, held)]), "labels")
        now_held, now = _held(after, len(quotas))
        if now <= kept:
            break
        state, held, kept = after, now_held, now
    return state, held


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per input row; `slot` counts from 0 in each shard.

    Null text has size 1 and counts as an empty text; null ids and repeated rows each take a place; an empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp"),
    ), "sizes")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]

    # parts of a group by the hash of the row, so that a group may be of any size
    salted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = materialize(salted.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    groups = materialize(parts.groupBy("grp").agg(F.sum("n").alias("members")), "groups")
    state, held = propagate(_ranges(groups.where("members > 1"), shards), quotas)

    # (grp, shard, low, n): members low to low + n - 1 of the group go to the shard
    spans = F.transform("counts", lambda n, s: F.struct(s.alias("shard"), n.alias("n"), _sum(F.slice("counts", 1, s)).alias("low")))
    linked = state.select("grp", F.inline(F.filter(spans, lambda x: x["n"] > 0)))
    linked = _ahead(linked, ["shard"], "n", "slot", lanes=512).select("grp", "shard", "n", "low", "slot")
    alone = _ahead(groups.where("members = 1"), [], "members", "ahead").select("grp", _place(F.col("ahead"), quotas, held).alias("at")).select(
        "grp", "at.shard", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("low"), "at.slot"
    )
    places = linked.unionAll(alone).groupBy("grp").agg(F.collect_list(F.struct("shard", "n", "low", "slot")).alias("places"))  # at most one a shard

    before = F.sum("n").over(Window.partitionBy("grp").orderBy("part")) - F.col("n")  # at most SALTS rows a group
    found = parts.select("grp", "part", before.alias("before")).join(places, "grp")
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy("doc_id", "size")) - 1
    ranked = salted.withColumn("inside", inside).join(found, ["grp", "part"]).withColumn("rank", F.col("before") + F.col("inside"))
    mine = F.filter("places", lambda p: (F.col("rank") >= p["low"]) & (F.col("rank") < p["low"] + p["n"]))[0]
    return ranked.withColumn("at", mine).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "at.shard",
        (F.col("at.slot") + F.col("rank") - F.col("at.low")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _place(rank: Column, quotas: list[int], held: list[int]) -> Column:
    """Shard and slot of the unlinked document of this rank: they fill the places that the linked ones leave."""
    place, low = None, 0
    for s, (quota, taken) in enumerate(zip(quotas, held)):
        high = low + quota - taken
        here = F.struct(F.lit(s).alias("shard"), (rank - low + taken).alias("slot"))
        place = F.when(rank < high, here) if place is None else place.when(rank < high, here)
        low = high
    return place
