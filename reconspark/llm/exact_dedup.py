"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut where its content says so (a sentence or line end after a least length), equal chunks
are reduced to one verified identifier, and two documents are equal when their ordered
identifier lists are.  Chunk texts move once, after partial aggregation; everything after that moves
32-byte identifiers, so a long document that repeats is never shuffled per copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import text_or_empty

#: A chunk ends at the first sentence or line end after MIN_CHUNK characters, at MAX_CHUNK at the latest.
MIN_CHUNK, MAX_CHUNK = 1024, 4096


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """Matches of this pattern cover a text without gaps: the second branch takes what the first leaves."""
    return rf"(?s).{{{least},{most}}}?[.!?\n]|.{{1,{most}}}"


def chunks(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """One row per chunk: doc_id, text_sha256, pos, chunk, chunk_sha.  An empty text is one empty chunk."""
    text = text_or_empty(text_col)
    parts = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_sha"), parts.alias("parts"))
        .select("doc_id", "text_sha", F.posexplode("parts").alias("pos", "chunk"))
        .withColumn("chunk_sha", F.unhex(F.sha2("chunk", 256)))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical; of equal ones the row with the largest id stays.
    Null text counts as empty, and empty texts are equal to each other.  A null id ranks below all ids.
    Rows repeated with id and text count each in group_size and are each returned; one of them is kept.
    An empty table gives an empty result.  Other columns of the input are ignored, whatever their names.
    An identifier that stood for two different chunk texts would stop the query with an error.
    """
    cut = chunks(docs, id_col, text_col, pattern or chunk_pattern())
    # Verified: the grouping compares the chunks' own bytes, so a hash that stands for two texts shows as two rows.
    verified = cut.groupBy("chunk_sha", "chunk").agg(F.count("*").alias("n")).groupBy("chunk_sha").agg(F.count("*").alias("texts"))
    verified = verified.withColumn("bucket", F.xxhash64("chunk_sha"))
    named = (
        cut.select("doc_id", "text_sha", "pos", "chunk_sha", F.xxhash64("chunk_sha").alias("bucket"))
        .join(verified, ["bucket", "chunk_sha"])
        .select("doc_id", "text_sha", "pos", F.when(F.col("texts") == 1, F.col("chunk_sha")).otherwise(F.raise_error(F.lit("a chunk identifier stands for two texts"))).alias("chunk_id"))
    )
    recipes = (
        named.groupBy("doc_id", "text_sha")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "chunk_id"))).alias("r"), F.count_if(F.col("pos") == 0).alias("copies"))
        .select("doc_id", "text_sha", "copies", F.transform("r", lambda x: x["chunk_id"]).alias("recipe"), F.size("r").cast("long").alias("n_chunks"))
    )
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.max("n_chunks").alias("n_chunks")).where("group_size > 1")
    # The second key makes both sides shuffle for the join, so that a hot recipe's partition can be split.
    joined = recipes.join(groups, ["n_chunks", "recipe"], "left")
    single = F.col("group_size").isNull()
    rows = joined.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.lower(F.hex("text_sha")).alias("text_sha256"), "n_chunks", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chunks")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each different text, the one with the largest id, with all its columns.

    Null counts as the empty text.  A null id stays only where all ids of the text are null; of rows repeated with
    id and text one stays.  An empty table gives an empty result; other columns are carried, whatever their names.
    """
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.unhex(F.sha2(text_or_empty(f"`{text_col}`"), 256)).alias("own_sha"))
    # Rows repeated with id and text are one text: dropDuplicates leaves one of them.
    same = F.col("own_sha").eqNullSafe(F.col("kept_sha")) & F.col("own_id").eqNullSafe(F.col("kept_id"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["own_sha", "own_id"]).select("row.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
