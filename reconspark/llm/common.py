"""Helpers that the operators share: table access, shared-folder tables, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master, where the session names none, a temporary one is made and set: on a cluster each
    executor would write to its own disk, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


#: Tables that this process has stored and not dropped.
_written: set[str] = set()
#: Spark's own switch for deleting a query's shuffle files once the query is over.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    ``free``: the shuffle files that writing it took are deleted right after, and the table is compressed more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        (df.write.option("compression", "zstd") if free else df.write).parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    _written.add(path)
    return table


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that no later step reads."""
    _delete(df.sparkSession, df.stored_path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written.discard(name)


def release(spark: SparkSession) -> int:
    """Delete the ``stored`` tables of this process, once the results that read them are done; how many went.

    A result that is read afterwards fails.  Tables of other processes in the folder stay.
    """
    paths = sorted(_written)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph of ``edges(a, b)`` as ``(node, component)``, the smallest node's value.

    Alternating large-star and small-star: each round links the neighbours of a node to the smallest one,
    so a path of length n is done after O(log n) rounds.  A hot node costs no task its whole neighbourhood:
    the smallest neighbour comes from a partially aggregated ``min``, and the join on the node's
    value is one that adaptive execution splits.  Every round is stored in the shared folder.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))

    def star(frame: DataFrame, large: bool) -> DataFrame:
        """Large: link the larger neighbours of each node to its smallest; small: link the smaller ones."""
        both = frame.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        if large:
            both = both.unionByName(frame.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        lowest = both.groupBy("node").agg(F.min("other").alias("least_other")).select("node", F.least("node", "least_other").alias("root"), F.xxhash64("node").alias("node_hash"))
        joined = both.withColumn("node_hash", F.xxhash64("node")).join(lowest, ["node", "node_hash"])
        if large:
            linked = joined.where("other > node").select(F.col("other").alias("hi"), F.col("root").alias("lo"))
        else:
            linked = joined.select(F.col("other").alias("hi"), F.col("root").alias("lo")).unionByName(lowest.select(F.col("node").alias("hi"), F.col("root").alias("lo")))
        return linked.where("hi <> lo").distinct()

    seen = None
    for _ in range(rounds):
        after = stored(star(star(pairs, True), False))
        drop_stored(pairs)
        pairs = after
        state = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if seen == (state["n"], state["x"]):
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = (state["n"], state["x"])
    raise RuntimeError(f"components did not settle in {rounds} rounds")
