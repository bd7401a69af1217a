"""Sharding by balanced label propagation, in DataFrame functions alone.

Linked documents (those of equal text) start on hashed shards and move, round by round, to the shard where most of
their neighbours are.  Quotas hold by exchange: of the moves that documents wish for between each pair of shards so many
are allowed that no shard gains more than it gives away and has room for, so full shards swap documents.  Rounds go on
until the number of documents away from their neighbours stops falling.  Documents of one group on one shard have the
same neighbours and move together, so a round joins counts per (group, shard) and not documents.  A group above the
quota is dealt out in blocks first; the few large blocks choose one after the other, so that they don't meet.  At last shards above their exact size hand rows to those below it,
unlinked rows first, which makes row counts at most one apart.  Ranks are made in two levels, so
that no task holds a shard or a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconspark.llm.common import drop_stored, stored, text_or_empty

SHARDS = 40
#: Propagation stops after this many rounds without fewer documents away from their neighbours.
PATIENCE = 2
#: A block of a large group is at most this share of a shard.
BLOCK_SHARE = 0.9
#: A block is large from this share of a shard on: there are at most so many a shard.
LARGE_BLOCKS = 8
#: Rows in a bucket of the two-level ranks.
BUCKET = 2_000
#: What a row costs besides its text, in bytes.
ROW_BYTES = 16


def by_shard(values: dict[int, int | float], key: F.Column, default=0) -> F.Column:
    """A value by shard number as an array lookup; there are as many entries as shards."""
    top = max([*values, 0]) + 1
    return F.element_at(F.array(*[F.lit(values.get(i, default)) for i in range(top)]), key + 1)


def allowed(wish: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], float]:
    """Share of the wished moves (from, to) that may happen: inflows are cut until none exceeds its shard's room and outflow.

    Works on one number for each pair of shards.
    """
    flow = {k: float(v) for k, v in wish.items()}
    for _ in range(1000):
        settled = True
        for s in room:
            inflow, outflow = sum(v for (_, to), v in flow.items() if to == s), sum(v for (at, _), v in flow.items() if at == s)
            if inflow > (room[s] + outflow) * (1 + 1e-6):
                settled, scale = False, (room[s] + outflow) / inflow
                flow = {(at, to): v * scale if to == s else v for (at, to), v in flow.items()}
        if settled:
            break
    return {k: v / wish[k] for k, v in flow.items()}


def place_large(cells: DataFrame, quota: int, n_shards: int) -> DataFrame:
    """``cells`` with the large blocks (at most LARGE_BLOCKS a shard) on the shards with most room for them, then most of their rows, the largest first."""
    large = cells.groupBy("unit").agg(F.sum("n").alias("all")).where(F.col("all") * LARGE_BLOCKS >= quota)
    at: dict[int, dict[int, int]] = {}
    for r in cells.join(large, "unit", "left_semi").groupBy("unit", "shard").agg(F.sum("n").alias("n")).collect():  # LARGE_BLOCKS * n_shards ** 2 rows at most
        at.setdefault(r["unit"], {})[r["shard"]] = r["n"]
    filled, target = dict.fromkeys(range(n_shards), 0), []
    for unit in sorted(at, key=lambda u: (-sum(at[u].values()), u)):
        size = sum(at[unit].values())
        best = max(filled, key=lambda s: (min(size, quota - filled[s]), at[unit].get(s, 0), -s))
        filled[best] += size
        target += [F.lit(unit), F.lit(best)]
    return cells.withColumn("shard", F.coalesce(F.create_map(*target)[F.col("unit")], "shard")) if target else cells


def propagate(cells: DataFrame, quota: int, n_shards: int) -> DataFrame:
    """``cells(unit, origin, n, shard)``, stored, with the shard that each (unit, origin) ends on."""
    cells, first = stored(place_large(cells, quota, n_shards)), cells
    drop_stored(first)
    least, stale, turn = None, 0, 0
    while True:
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row per shard
        room = {s: max(0, quota - load.get(s, 0)) for s in range(n_shards)}
        here = cells.groupBy("unit", "shard").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("unit")))
        # The shard wins where most of the block can be together; of equal ones that of most neighbours, then by a hash.
        reach = F.least(F.col("all"), F.col("n") + by_shard(room, F.col("shard")))
        best = here.groupBy("unit").agg(F.max_by("shard", F.struct(reach.alias("reach"), F.col("n"), F.xxhash64("unit", "shard"))).alias("target"))
        wishes = cells.join(best, "unit")
        wish = {(r["shard"], r["target"]): r["n"] for r in wishes.where("shard <> target").groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}  # one row per pair of shards
        away = sum(wish.values())
        stale = 0 if least is None or away < least else stale + 1
        if not away or stale >= PATIENCE:
            return cells
        least, turn = away if least is None else min(least, away), turn + 1
        share = allowed(wish, room)
        pairs = F.lit([share.get((a, b), 0.0) for a in range(n_shards) for b in range(n_shards)])
        chance = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        goes = (F.col("shard") != F.col("target")) & (chance < F.element_at(pairs, F.col("shard") * n_shards + F.col("target") + 1))
        moved = stored(wishes.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).drop("target"))
        drop_stored(cells)
        cells = moved


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    ``slot`` counts the rows of a shard from 0 without gaps.  Null text: crc32 of the empty text, size 16; it is linked
    with empty texts.  Repeated rows are rows of their own, linked like other equal texts; null ids are carried.
    With fewer rows than shards some stay empty; an empty table gives an empty result.
    Other columns are ignored.
    """
    text = text_or_empty(text_col)
    base = stored(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g"))
        .withColumn("gh", F.xxhash64("g"))
        .withColumn("h", F.xxhash64("doc_id", "gh", F.lit(1)))
    )
    n = base.count()
    quota = -(-n // n_shards)

    # Linked rows carry their block; all rows start on a hashed shard.
    groups = base.groupBy("g").agg(F.count("*").alias("linked")).where("linked > 1").withColumn("gh", F.xxhash64("g"))
    block = F.pmod(F.xxhash64("h"), F.ceil(F.col("linked") / max(1.0, BLOCK_SHARE * quota)))
    placed = stored(
        base.join(groups, ["g", "gh"], "left")
        .withColumn("unit", F.when(F.col("linked").isNotNull(), F.xxhash64("g", block)))
        .withColumn("origin", F.pmod(F.xxhash64("h", F.lit(2)), F.lit(n_shards)).cast("int"))
        .drop("g", "gh", "linked")
    )
    drop_stored(base)
    cells = propagate(stored(placed.where("unit IS NOT NULL").groupBy("unit", "origin").agg(F.count("*").alias("n")).withColumn("shard", F.col("origin"))), quota, n_shards)

    # Hand-over order within a shard: unlinked rows first, then block by block.  A bucket holds many small blocks, or
    # a part of a large one.
    buckets = max(1, n // (n_shards * BUCKET))
    parts = F.ceil(F.sum("n").over(Window.partitionBy("unit", "shard")) / BUCKET)
    at = cells.select("unit", "origin", F.col("shard").alias("moved_to"), parts.alias("parts"))
    rows = placed.join(at, ["unit", "origin"], "left").withColumn("shard", F.coalesce("moved_to", "origin"))
    rows = stored(
        rows.withColumn("first", F.when(F.col("unit").isNull(), F.pmod("h", F.lit(buckets))).otherwise(buckets + F.pmod("unit", F.lit(buckets))).cast("int"))
        .withColumn("second", F.when(F.col("parts") > 1, 1 + F.pmod(F.xxhash64("h"), F.col("parts"))).otherwise(F.lit(0)).cast("int"))
        .select("doc_id", "size", "text_crc32", "unit", "h", "shard", "first", "second")
    )
    drop_stored(placed)
    drop_stored(cells)
    counts = rows.groupBy("shard", "first", "second").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("first", "second")) - F.col("n")).drop("n")
    inside = Window.partitionBy("shard", "first", "second").orderBy("unit", "h", "doc_id", "size")
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(ahead, ["shard", "first", "second"]).withColumn("rank", F.col("r") + F.col("before") - 1)

    load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row per shard
    size = {s: n // n_shards + (s < n % n_shards) for s in range(n_shards)}
    surplus = {s: max(0, load.get(s, 0) - size[s]) for s in size}
    given, taken, gives, takes = 0, 0, {}, []
    for s in size:
        gives[s] = given
        given += surplus[s]
        lack = max(0, size[s] - load.get(s, 0))
        if lack:
            takes.append((taken, s, load.get(s, 0)))
            taken += lack
    out = F.col("rank") < by_shard(surplus, F.col("shard"))
    number = by_shard(gives, F.col("shard")) + F.col("rank")  # among all rows handed over
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for start, s, filled in takes:  # the last one whose start is reached holds
        to, slot = F.when(number >= start, F.lit(s)).otherwise(to), F.when(number >= start, number - start + filled).otherwise(slot)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(out, to).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.when(out, slot).otherwise(F.col("rank") - by_shard(surplus, F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
