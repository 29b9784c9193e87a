"""The queries of the training-data operators, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import class_lm, decontaminate, language_id, nbest_pieces, near_dedup, pu_quality, quality_rules, sharding, style_tree, token_files
from .common import crc_fold, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark, sf_dir):
    return sharding.compacted(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_pu_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 5) == 0)
    model = pu_quality.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(crc_fold("doc_id", 5) != 0))
    return pu_quality.score(docs, model, keys=("doc_id", "held_out"))


def op5_nbest_pieces(spark, sf_dir):
    return nbest_pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), kept=160 << 20)


def op6_minhash(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 4) == 2)
    profiles = language_id.fit(docs.where(~F.col("held_out")))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_style_tree(spark, sf_dir):
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op10_class_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 5) == 1)
    model, rare = class_lm.fit(docs.where(~F.col("held_out")))
    return class_lm.score(docs, model, rare, keys=("doc_id", "held_out"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_token_files": op3_token_files,
    "op4_pu_quality": op4_pu_quality,
    "op5_nbest_pieces": op5_nbest_pieces,
    "op6_minhash": op6_minhash,
    "op7_language_id": op7_language_id,
    "op8_style_tree": op8_style_tree,
    "op9_quality_rules": op9_quality_rules,
    "op10_class_lm": op10_class_lm,
}

ORACLE_SQL = {
    "op1_sharding": sharding.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op6_minhash": near_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
}
