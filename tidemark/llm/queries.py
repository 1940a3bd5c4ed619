"""The numbered queries on whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, fim, idfile, licences, lines, negatives, packing, quality, sharding, simhash, suffixes, toxicity, warc
from tidemark.session import prepare
from tidemark.sources.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(prepare(spark), sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(prepare(spark), sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(prepare(spark), sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(prepare(spark), sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(prepare(spark), sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(prepare(spark), sf_dir, "documents"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(table(prepare(spark), sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(prepare(spark), sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(prepare(spark), sf_dir, "pages"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(prepare(spark), sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(prepare(spark), sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_suffix_dedup, op4_licences, op5_line_dedup, op6_decontamination, op7_sharding, op8_id_files, op9_toxicity, op10_packing, op11_warc, op12_fill_in_middle, op13_hard_negatives)}
SQL = {"op1_quality_rules": quality.BASE_SQL, "op4_licences": licences.SQL, "op5_line_dedup": lines.SQL, "op6_decontamination": decontaminate.SQL, "op11_warc": warc.SQL, "op12_fill_in_middle": fim.SQL, "op13_hard_negatives": negatives.SQL}
