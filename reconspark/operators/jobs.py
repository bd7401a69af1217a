"""Job history: faceted search, listing, stale states."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form and case folding: the one text function Spark lacks here."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def search(jobs: DataFrame, query: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Jobs whose title, subtitle, id, kind, status or kind's aliases hold all terms."""
    terms = unicodedata.normalize("NFKC", query or "").casefold().split()
    if not terms:
        return jobs
    words = F.lit("")
    for kind, text in (aliases or {}).items():
        words = F.when(F.col("kind") == kind, F.lit(text)).otherwise(words)
    hay = nfkc(F.concat_ws(" ", "title", "subtitle", F.col("id").cast("string"), "kind", "status", words))
    found = jobs.withColumn("_hay", hay)
    for t in terms:
        found = found.where(F.col("_hay").contains(t))
    return found.drop("_hay")


def facets(jobs: DataFrame, query: str = "", kind: str = "all", status: str = "all", aliases: dict[str, str] | None = None) -> DataFrame:
    """(facet, value, n): totals, kind counts under search and the chosen status, status counts under search and the chosen kind,
    and counts of all jobs by status.  One pass: each searched row is counted in every facet it belongs to."""
    found = search(jobs, query, aliases)
    by_kind = F.lit(True) if kind == "all" else F.col("kind") == kind
    by_status = F.lit(True) if status == "all" else F.col("status") == status
    marks = F.array_compact(F.array(
        F.when(by_status, F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("value"))),
        F.when(by_kind, F.struct(F.lit("status").alias("facet"), F.col("status").alias("value"))),
        F.when(by_kind & by_status, F.struct(F.lit("total").alias("facet"), F.lit("").alias("value"))),
    ))
    scoped = found.select(F.explode(marks).alias("m")).groupBy("m.facet", "m.value").agg(F.count("*").alias("n"))
    every = jobs.groupBy(F.lit("summary").alias("facet"), F.col("status").alias("value")).agg(F.count("*").alias("n"))
    return scoped.unionByName(every)


def page(jobs: DataFrame, limit: int | None = 50) -> DataFrame:
    """The newest jobs, 10 to 1000 of them, without their maps."""
    n = max(10, min(int(limit or 50), 1000))
    plain = [f.name for f in jobs.schema if f.dataType.typeName() not in ("map", "array", "struct")]
    return jobs.select(*plain).orderBy(F.desc("created_at"), "id").limit(n)


def settle_stale(jobs: DataFrame) -> DataFrame:
    """Jobs that a restart found queued or running have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))
