"""Registered queries of the training-data operators, with SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.llm.automata import ORACLE as AUTOMATA_SQL
from cartulary.llm.codes import ORACLE as CODES_SQL
from cartulary.llm.sharding import ORACLE as SHARDING_SQL
from cartulary.llm.topk import ORACLE as TOPK_SQL
from cartulary.llm.trie import ORACLE as TRIE_SQL
from cartulary.plans.catalogue import Query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op3_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.sitetree import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cartulary.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.lm import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from cartulary.llm.rollup import bpe_counter, documents_history, word_counter
    from cartulary.session import ensure_checkpoint_dir

    encoders = {"words-1": word_counter, "bytes-bpe-50k": bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}
    return documents_history(table(spark, sf_dir, "documents"), encoders, f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op11_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.automata import remove_repeated_windows

    return remove_repeated_windows(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.codes import product_codes

    return product_codes(table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


RUNNERS = (op1_quality_ranking, op2_best_fit_packing, op3_nra_topk, op4_site_style_tree, op5_suffix_array_dedup, op6_minhash_neardup, op7_log_bilinear_lm, op8_bm25_decontamination, op9_token_rollup, op10_extendible_sharding, op11_suffix_automata, op12_vector_codes, op13_conversation_trie, pipeline)
SQL: dict[str, str] = {"op3_nra_topk": TOPK_SQL, "op10_extendible_sharding": SHARDING_SQL, "op11_suffix_automata": AUTOMATA_SQL, "op12_vector_codes": CODES_SQL, "op13_conversation_trie": TRIE_SQL}


def load_llm_queries() -> dict[str, Query]:
    import corpus_pipeline  # noqa: F401  a missing pipeline removes all queries of the subpackage
    return {run.__name__: Query(run, SQL.get(run.__name__)) for run in RUNNERS}
