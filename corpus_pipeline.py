"""A training corpus from raw documents: clean, dedup, near-dedup, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  ``run`` writes each stage's rows to the shared folder and reads them as the next one's input; a stage's
table is deleted once the next stage's is written, the last one stays for the result that reads it.

Rows without words (null or empty texts among them) fail the quality rules.  Null ids and sources are carried; a null source is
a source of its own in the mix.  Rows repeated with id and text are one document from exact dedup on, rows of one id and
different texts stay apart.  Ties are settled by id, then by a hash of the text, so reruns agree.  An empty table gives an
empty result; extra columns are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from reconspark.llm import exact_dedup, mixing, packing, quality, simhash
from reconspark.llm.common import drop_stored, stored, table


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the quality rules go."""
    return quality.keep_good(docs)


def exact_duplicates(spark, docs, sf_dir):
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates the row with the smallest id stays."""
    return simhash.keep_one(docs)


def mixed(spark, docs, sf_dir):
    """Each document as often as the mix takes it, to the nearest whole number."""
    return mixing.apply(docs)


def packed(spark, docs, sf_dir):
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_duplicates), ("simhash_dedup", near_duplicates), ("mix_sources", mixed), ("best_fit_packing", packed)]

#: SQL cannot express the SimHash components and the packing; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
