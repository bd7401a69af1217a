"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconspark.llm import bpe, exact_dedup, html_text, licences, mixing, packing, pii, quality, sharding, simhash, spelling, toxicity, whitening
from reconspark.llm.common import table


def op1_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def op4_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_licences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan(docs.select("doc_id", path.alias("path"), "text"))


def op6_pack_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.measure(table(spark, sf_dir, "documents")).drop("kept_chars", "lost")


def op10_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op11_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op12_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries():
    return {"op1_html_text": op1_html_text, "op2_simhash": op2_simhash, "op3_exact_dedup": op3_exact_dedup, "op4_shards": op4_shards, "op5_licences": op5_licences, "op6_pack_sequences": op6_pack_sequences, "op7_toxicity": op7_toxicity, "op8_mix_sources": op8_mix_sources, "op9_quality_rules": op9_quality_rules, "op10_pii": op10_pii, "op11_bpe": op11_bpe, "op12_spelling": op12_spelling, "op13_whitening": op13_whitening}


def oracle_sql():
    return {"op3_exact_dedup": exact_dedup.ORACLE, "op9_quality_rules": quality.ORACLE}
