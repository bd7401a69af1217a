"""Exact order statistics of columns of any size, by key: no task holds or sorts a whole key.

A pass makes a sketch of each key's values (``percentile_approx``, which tasks merge), takes from it two values that enclose the wanted
rank, and counts exactly what lies below them, on them and between them.  If the rank falls on one of the two, that is the
answer; else only the rows strictly between go on, a few thousandths of them, so repeated values cannot hold a pass up.
Keys with at most BUCKET rows left are sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.operators.frames import kept

#: Rows of a key that are sorted together; steps of the sketch and how much finer it is than they are.
BUCKET, STEPS, FINER = 50_000, 500, 20


def _join(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their key's row; the second key makes both sides move for the join, so that a hot key's part can be split."""
    if not keys:
        return rows.crossJoin(F.broadcast(one))  # one row, or one for each rank
    salted = lambda df: df.withColumn("_salt", F.xxhash64(*keys))
    return salted(rows).join(salted(one), [*keys, "_salt"]).drop("_salt")


def at_ranks(rows: DataFrame, value: str, keys: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per key: the keys, n, and of each name the value at the 0-based rank that its function gives for n.

    Null and NaN values are left out; null keys are a key like any other.  A rank outside 0 .. n - 1 gives null.  Without rows there is no row of a key, and
    without keys one row of n = 0 and nulls.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    # Keys as structs are never null, so equality finds null keys too.
    own = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*[F.struct(F.col(k)).alias(n) for k, n in zip(keys, named)], F.col(value).alias("_v"))
    pick = lambda name: F.get(F.col("_all"), ranks[name](F.col("n")).cast("int")).alias(name)
    counted = kept(own.groupBy(*named).agg(F.count("*").alias("n")))
    large, small = counted.where(F.col("n") > BUCKET), counted.where(F.col("n") <= BUCKET)
    if large.isEmpty():
        told = own.groupBy(*named).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("_v")).alias("_all"))
        done = told.select(*named, "n", *[pick(name) for name in ranks])
    else:
        wanted = large.select(*named, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), ranks[name](F.col("n")).cast("long").alias("_rank")) for name in ranks])).alias("w")).select(*named, "n", "w.*")
        found = _select(_join(own, large.select(*named), named), wanted, named)
        chosen = found.groupBy(*named).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
        done = _join(large, chosen, named).select(*named, "n", *ranks)
        if keys:
            told = _join(own, small.select(*named), named).groupBy(*named).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("_v")).alias("_all"))
            done = done.unionByName(told.select(*named, "n", *[pick(name) for name in ranks]))
    return done.select(*[F.col(n)[k].alias(k) for k, n in zip(keys, named)], "n", *ranks)


def _select(own: DataFrame, wanted: DataFrame, named: list[str]) -> DataFrame:
    """(keys, _name, _v) for ``wanted(keys, n, _name, _rank)``: passes of narrowing over ``own(keys, _v)``.

    The first pass serves all ranks of a key with one sketch; from then on a rank has rows of its own.
    """
    targets = [*named, "_name"]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), STEPS * FINER).alias("_sketch")
    own, by = kept(own), named
    found = None
    while True:
        grids = own.groupBy(*by).agg(sketch)
        step = F.floor(F.col("_rank") * STEPS / F.col("n")).cast("int")
        at = lambda s: F.get("_sketch", F.least(F.greatest(s, F.lit(0)), F.lit(STEPS)))
        bounds = _join(wanted.where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("n"))), grids, by).select(*targets, "n", "_rank", at(step - 1).alias("_low"), at(step + 2).alias("_high"))
        bounds = kept(bounds)
        marked = _join(own, bounds, named if by == named else targets)
        below, on_low, inside = F.col("_v") < F.col("_low"), F.col("_v") == F.col("_low"), (F.col("_v") > F.col("_low")) & (F.col("_v") < F.col("_high"))
        counts = marked.groupBy(*targets).agg(F.count_if(below).alias("_below"), F.count_if(on_low).alias("_on"), F.count_if(inside).alias("_inside"))
        state = _join(bounds, counts, targets)
        first, last = F.col("_below") + F.col("_on"), F.col("_below") + F.col("_on") + F.col("_inside")
        # A sketch is off by less than a step; if a rank should lie outside all the same, its side of the bounds goes on.
        state = kept(state.withColumn("_way", F.when(F.col("_rank") < F.col("_below"), "under").when(F.col("_rank") < first, "low").when(F.col("_rank") < last, "inside").otherwise("from_high")))
        hit = state.where("_way = 'low'").select(*targets, F.col("_low").alias("_v"))
        rest = state.where("_way <> 'low'")
        flow = _join(own, rest.select(*targets, "_low", "_high", "_way"), named if by == named else targets)
        flow = flow.where(F.when(F.col("_way") == "inside", inside).when(F.col("_way") == "under", below).otherwise(F.col("_v") >= F.col("_high")))
        gone = F.when(F.col("_way") == "inside", first).when(F.col("_way") == "under", F.lit(0)).otherwise(last)
        size = F.when(F.col("_way") == "inside", F.col("_inside")).when(F.col("_way") == "under", F.col("_below")).otherwise(F.col("n") - last)
        wanted = kept(rest.select(*targets, size.alias("n"), (F.col("_rank") - gone).alias("_rank")))
        own, by = kept(flow.select(*targets, "_v")), targets
        few = wanted.where(F.col("n") <= BUCKET)
        sorted_few = _join(own, few, targets).groupBy(*targets).agg(F.sort_array(F.collect_list("_v")).alias("_all"), F.max("_rank").alias("_rank")).select(*targets, F.get("_all", F.col("_rank").cast("int")).alias("_v"))
        found = hit.unionByName(sorted_few) if found is None else found.unionByName(hit).unionByName(sorted_few)
        wanted = wanted.where(F.col("n") > BUCKET)
        if wanted.isEmpty():
            return found
        own = _join(own, wanted.select(*targets), targets)


def quantiles(rows: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """One row per key: n and the exact quantiles, interpolated between neighbours as ``percentile`` does."""
    ranks = {}
    for i, p in enumerate(shares.values()):
        ranks[f"_a{i}"] = lambda n, p=p: F.floor((n - 1) * p)
        ranks[f"_b{i}"] = lambda n, p=p: F.ceil((n - 1) * p)
    at = at_ranks(rows.withColumn(value, F.col(value).cast("double")), value, keys, ranks)
    part = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    between = lambda i, p: F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(F.col(f"_a{i}") * (1 - part(p)) + F.col(f"_b{i}") * part(p))
    return at.select(*keys, "n", *[between(i, p).alias(name) for i, (name, p) in enumerate(shares.items())])


def median(rows: DataFrame, value: str, keys: list[str], name: str = "median") -> DataFrame:
    return quantiles(rows, value, keys, {name: 0.5})
