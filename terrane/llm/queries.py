"""The text operators' queries, each over its whole tables with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, fim, fuzzy_lines, hmm, minhash, packing, passages, quality, spelling, substrings, token_counts, topk, toxicity, urls
from terrane.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.clean(table(spark, sf_dir, "documents"), kind="line")
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op3_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model(table(spark, sf_dir, "documents"), folds=10)


def op4_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_repeats(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, fold=1, cut=0.7)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, fold=2, cut=0.7)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_substring_dedup,
        op2_passage_dedup,
        op3_hmm_language_model,
        op4_exact_topk_search,
        op5_benchmark_decontamination,
        op6_minhash_near_dedup,
        op7_fuzzy_line_dedup,
        op8_toxicity,
        op9_packing,
        op10_quality_classifier,
        op11_fill_in_middle,
        op12_token_counts,
        op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": urls.JUDGE_SQL,
    "op2_substring_dedup": substrings.CLEAN_SQL,
    "op4_exact_topk_search": topk.SEARCH_SQL,
    "op5_benchmark_decontamination": decontaminate.REPORT_SQL,
    "op11_fill_in_middle": fim.DIGESTS_SQL,
    "op13_spelling_variants": spelling.VARIANTS_SQL,
}
