"""op1 to op13 over the driver tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from gleaner.llm import asof, decontam, importance, langid, mixing, quality, shard, simhash, suffix, tokens, urlrules, warc, winnow
from gleaner.llm.sql import SQL

QUERIES: dict[str, tuple] = {}


def _query(name):
    def add(f):
        QUERIES[name] = (f, SQL.get(name))
        return f

    return add


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("op1_url_rules")
def op1(spark, sf_dir):
    return urlrules.url_report(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")).drop("mined_rule")


@_query("op2_warc_archives")
def op2(spark, sf_dir):
    return warc.archive_report(_read(spark, sf_dir, "pages"))


@_query("op3_language_id")
def op3(spark, sf_dir):
    return langid.language_report(_read(spark, sf_dir, "documents"))


@_query("op4_suffix_dedup")
def op4(spark, sf_dir):
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"))


@_query("op5_source_mixing")
def op5(spark, sf_dir):
    return mixing.taken_words(_read(spark, sf_dir, "documents")).drop("source")


@_query("op6_byte_sharding")
def op6(spark, sf_dir):
    return shard.shard_report(_read(spark, sf_dir, "documents"))


@_query("op7_quality_rules")
def op7(spark, sf_dir):
    return quality.quality_report(_read(spark, sf_dir, "documents"))


@_query("op8_decontamination")
def op8(spark, sf_dir):
    return decontam.contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query("op9_token_files")
def op9(spark, sf_dir):
    return tokens.token_report(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op10_simhash")
def op10(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


@_query("op11_point_in_time")
def op11(spark, sf_dir):
    return asof.feature_table(_read(spark, sf_dir, "sales"), _read(spark, sf_dir, "clicks"), _read(spark, sf_dir, "sale_lines"))


@_query("op12_importance")
def op12(spark, sf_dir):
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query("op13_winnowing")
def op13(spark, sf_dir):
    return winnow.edit_report(_read(spark, sf_dir, "documents")).drop("n_kept")
