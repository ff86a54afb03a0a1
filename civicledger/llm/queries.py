"""The queries of this subpackage and, where SQL can express one, its DuckDB twin."""
from __future__ import annotations

import corpus_pipeline
from civicledger.llm import bpe, conversations, exact_dedup, fingerprints, line_dedup, near_dedup, packing, pii, quality, sharding, spelling, suffixes, warc
from civicledger.llm.common import documents

QUERIES = {
    "op1_line_dedup": lambda spark, sf_dir: line_dedup.op1(documents(spark, sf_dir)),
    "op2_exact_dedup": lambda spark, sf_dir: exact_dedup.op2(documents(spark, sf_dir)),
    "op3_pii": lambda spark, sf_dir: pii.op3(documents(spark, sf_dir)),
    "op4_minhash_near_dedup": lambda spark, sf_dir: near_dedup.op4(documents(spark, sf_dir)),
    "op5_quality_classifier": lambda spark, sf_dir: quality.op5(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op6_packing": lambda spark, sf_dir: packing.op6(documents(spark, sf_dir)),
    "op7_bpe": lambda spark, sf_dir: bpe.op7(documents(spark, sf_dir)),
    "op8_fingerprints": lambda spark, sf_dir: fingerprints.compare_with_next(documents(spark, sf_dir)),
    "op9_suffix_dedup": lambda spark, sf_dir: suffixes.op9(documents(spark, sf_dir)),
    "op10_sharding": lambda spark, sf_dir: sharding.shard_documents(documents(spark, sf_dir)),
    "op11_spelling_variants": lambda spark, sf_dir: spelling.op11(documents(spark, sf_dir)),
    "op12_warc": lambda spark, sf_dir: warc.op12(spark.read.parquet(f"{sf_dir}/pages.parquet")),
    "op13_conversation_repair": lambda spark, sf_dir: conversations.op13(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_minhash_near_dedup": near_dedup.OP4_SQL,
    "op9_suffix_dedup": suffixes.OP9_SQL,
    "op12_warc": warc.OP12_SQL,
}
