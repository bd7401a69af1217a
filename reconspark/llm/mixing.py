"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The mix is a sequence of slots of BLOCK words.  Slot k takes the golden-ratio point frac((k + 1/2) * phi)
through the cumulative slots that the sources need to a source, so every stretch of the schedule is close to the
weights.  Within a source, documents are shuffled by a hash and cut into blocks of BLOCK words (the last one
shorter); its r-th slot takes block r, starting again from the first when all are used.  What the schedule is off by,
a few slots a source, is set right at its end: slots beyond the target go, missing ones follow, and the
last one is cut where the target is reached, so that a source of any size takes its target to within one word.
Ranks and running sums are made in two levels (counts per chunk, then within a chunk), so that no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconspark.llm.common import WHITE_SPACE, stored, text_or_empty

#: Words in a block: the schedule's grain.
BLOCK = 64
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often than this.
MOST_PASSES = 3
#: Slots, or documents, in a chunk of the two-level ranks.
CHUNK = 2_000
#: Half of the golden ratio's fraction, (sqrt(5) - 1) / 4, in units of 2^-62.
HALF_GOLDEN = 1_425_089_352_415_399_810
LOW = (1 << 31) - 1


def word_count(column: F.Column) -> F.Column:
    """Number of words; leading white space makes one empty part, trailing white space another."""
    parts = F.split(column, WHITE_SPACE)
    return F.size(parts).cast("long") - (F.element_at(parts, 1) == "").cast("long") - ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``sizes(source, source_size)`` with each source's target.

    Sources in code-point order, null last, weigh 5, 2, 1, repeating.  Weights share all words; a source whose
    share is above ``most`` times its size stops there and the excess is shared again by weight.  In order of
    size per weight the stopped sources come first, so one running sum finds them: with S words and W weight
    left after the first j sources, source j is stopped iff w * S / W > most * size.
    Works on one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights)) + 1))
    cap = F.col("source_size") * float(most)
    fill = Window.orderBy(cap / F.col("weight"), "i")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left_size = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = ranked.select("*", left_size.alias("left_size"), left_weight.alias("left_weight")).withColumn("free", F.col("left_size") * F.col("weight") <= cap * F.col("left_weight"))
    # The first source that is not stopped fixes the level of all that follow.
    level = F.max(F.when(F.col("free"), F.struct("left_weight", "left_size"))).over(everything)
    rate = level["left_size"] / level["left_weight"]
    return filled.withColumn("target", F.when(F.col("free"), F.col("weight") * rate).otherwise(cap)).select("source", "source_size", "i", "target")


def golden_point(k: F.Column) -> F.Column:
    """frac((k + 1/2) * phi) as (2 k + 1) * phi / 2 modulo 1 by integers of two 31-bit halves: doubles lose the fraction of large products."""
    odd, high_half, low_half = k * 2 + 1, HALF_GOLDEN >> 31, HALF_GOLDEN & LOW
    low, high = odd.bitwiseAND(LOW), F.shiftright(odd, 31)
    carried = ((low * high_half).bitwiseAND(LOW) + (high * low_half).bitwiseAND(LOW)).bitwiseAND(LOW)
    return (F.shiftleft(carried, 31) + low * low_half).bitwiseAND((1 << 62) - 1) / float(1 << 62)


def taken_words(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, most: int) -> DataFrame:
    """doc_id, bytes and h of every row with what ``mix`` returns; h is a hash of id and text."""
    text = text_or_empty(text_col)
    base = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.octet_length(text).alias("bytes"), F.xxhash64(F.col(id_col), text).alias("h")))
    spark = base.sparkSession
    goal, blocks = F.col("goal"), F.ceil(F.col("source_size") / block)
    over = F.when(F.col("source_size") > 0, goal % F.col("source_size")).otherwise(F.lit(0))  # words of the last, unfinished pass
    # How many slots a source needs: blocks of whole passes, then those of the words left.
    need = F.when((goal > 0) & (F.col("source_size") > 0), F.floor(goal / F.col("source_size")) * blocks + F.ceil(over / block)).otherwise(F.lit(0)).cast("long")
    known = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), most=most).withColumn("goal", F.least(F.round("target").cast("long"), most * F.col("source_size")))
    upper = F.sum("need").over(Window.orderBy("i"))
    known = stored(known.withColumn("need", need).withColumn("upper", upper).select("*", blocks.cast("long").alias("blocks"), over.alias("over")))
    n_docs = base.count()
    facts = known.agg(F.max("upper").alias("slots"), F.count("*").alias("sources")).first()
    n_slots, cells = facts["slots"] or 0, max(1, facts["sources"])

    # Documents of a source in hash order, each with the words before it.
    chunks = max(1, n_docs // CHUNK)
    placed = base.join(known.select(F.col("source").alias("s"), "i", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).withColumn("chunk", F.floor((F.shiftrightunsigned("h", 40) * F.lit(chunks)) / F.lit(1 << 24)))
    before_chunk = placed.groupBy("i", "chunk").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("i").orderBy("chunk")) - F.col("n")).select("i", "chunk", "before")
    inside = Window.partitionBy("i", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(inside)).join(before_chunk, ["i", "chunk"]).withColumn("end", F.col("end") + F.col("before"))
    placed = stored(placed.select("doc_id", "bytes", "h", "size", "source_size", "target", "i", "end", (F.col("end") - F.col("size")).alias("start")))

    # Slots: k to its source, by the cell of its point among the cells that the source's interval touches.
    cell = lambda x: F.floor(x * (cells / max(1, n_slots)))
    lower = F.col("upper") - F.col("need")
    intervals = known.where("need > 0").select("i", lower.alias("lower"), "upper", F.explode(F.sequence(cell(lower), cell(F.col("upper")))).alias("cell"))
    slots = spark.range(int(n_slots)).select("id", (golden_point(F.col("id")) * float(n_slots)).alias("point")).withColumn("cell", cell(F.col("point"))).join(intervals, "cell")
    slots = slots.where("lower <= point AND point < upper").select("id", "i", F.floor(F.col("id") / CHUNK).alias("chunk"))
    ahead = slots.groupBy("i", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("i").orderBy("chunk")) - F.col("n")).select("i", "chunk", "before", "n")
    ahead = stored(ahead)
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("i", "chunk").orderBy("id"))).join(ahead, ["i", "chunk"]).select("i", (F.col("r") + F.col("before") - 1).alias("rank"))
    # The schedule's end: ranks that a source still lacks, a few of each.
    had = ahead.groupBy("i").agg(F.sum("n").alias("had"))
    lacking = known.join(had, "i", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need").select("i", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"))
    last = (F.col("rank") == F.col("need") - 1) & (F.col("over") % block > 0)
    used = (
        ranked.unionByName(lacking).join(known.select("i", "need", "blocks", "over"), "i").where("rank < need")
        .groupBy("i", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count_if(~last).alias("times"), F.max(F.when(last, F.col("over") % block)).alias("cut"))
    )

    # A document lies in the blocks from start to end; what each slot takes of it adds up.
    whole = placed.where("size > 0").select("doc_id", "i", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    first = F.greatest("start", F.col("block") * block)
    part = F.least("end", (F.col("block") + 1) * block) - first
    cut = F.when(F.col("cut").isNotNull(), F.greatest(F.least("end", F.col("block") * block + F.col("cut")) - first, F.lit(0)))
    took = whole.join(used, ["i", "block"]).groupBy("i", "start").agg(F.sum(part * F.col("times") + F.coalesce(cut, F.lit(0))).cast("long").alias("taken"))
    # Within a source at most one document of size above 0 starts at a given word.
    return (
        placed.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
        .join(took.withColumnRenamed("start", "at"), ["i", "at"], "left")
        .select("doc_id", "bytes", "h", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, most: int = MOST_PASSES) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    The taken words of a source add up to its target, rounded.  Null text has size 0 and is taken 0 times; a null
    source is a source of its own, the last.  Repeated rows are documents of their own.  Same input, same mix: the
    shuffle is a hash of id and text.  An empty table gives an empty result; other columns are ignored.
    """
    return taken_words(docs, id_col, text_col, source_col, block, most).drop("bytes", "h")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, to the nearest whole number: none, one or several times.

    Rows repeated with id and text are taken together as often as the mix takes all of them: each so often, and
    one of them the rest.  Rows of null or empty text go; null ids and sources are carried; an empty table gives an empty
    result; all columns are carried, whatever their names.
    """
    taken = taken_words(docs, id_col, text_col, source_col, BLOCK, MOST_PASSES).where("size > 0")
    taken = stored(taken.groupBy("doc_id", "bytes", "h").agg(F.count("*").alias("rows"), F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("copies")).where("copies > 0"))
    text = text_or_empty(f"`{text_col}`")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.octet_length(text).alias("own_bytes"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("own_h"))
    same = (F.col("own_h") == F.col("h")) & F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_bytes") == F.col("bytes"))
    times = lambda n: F.explode(F.sequence(F.lit(1), n))
    out = keyed.join(taken.where("copies >= rows"), same).select("row", times(F.expr("copies div rows").cast("int")))
    rest = taken.where("copies % rows > 0")
    if not rest.isEmpty():
        out = out.unionByName(keyed.join(rest, same).dropDuplicates(["own_h", "own_id", "own_bytes"]).select("row", times(F.col("copies") % F.col("rows")).alias("col")))
    return out.select("row.*")
