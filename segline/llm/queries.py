"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, byte_bpe, chat_tree, kd_shards, license_scan, line_dedup, media, near_dedup, oracles, packing, quality_rules, repair, token_files, whitening
from .storage import table


def op1_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op2_adaptive_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_kd_sharding(spark, sf_dir):
    return kd_shards.shard_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.drop_repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_iso_media(spark, sf_dir):
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op8_token_planes(spark, sf_dir):
    return token_files.tokens_on_disk(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_audit_repair(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations")
    return repair.audit_conversations(repair.damaged(convs), convs)


def op12_chat_tree(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    controls = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", controls), (-1, 1, "assistant", controls)], "conv_id long, turn long, role string, text string")
    return chat_tree.digests(chat_tree.read_tree(*chat_tree.format_tree(convs.unionByName(own))))


def op13_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_adaptive_ann, op3_license_scan, op4_byte_bpe, op5_kd_sharding, op6_line_dedup, op7_iso_media, op8_token_planes, op9_quality_rules, op10_best_fit_packing, op11_audit_repair, op12_chat_tree, op13_whitening)}

ORACLE: dict[str, str] = {op1_minhash_near_dedup.__name__: oracles.NEAR, op2_adaptive_ann.__name__: oracles.NEAREST, op3_license_scan.__name__: oracles.LICENSE, op6_line_dedup.__name__: oracles.LINES, op12_chat_tree.__name__: oracles.CHAT}
