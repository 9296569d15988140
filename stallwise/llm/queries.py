"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import compression_bands, conversation_repair, hard_negatives, language_id, language_model, line_dedup, metric_search, packing, page_text, piece_sampling, preferences, simhash, suffix_dedup
from stallwise.llm.shared import table, tokenizer_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_spans", "text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.adjacent_preferences(table(spark, sf_dir, "conversations"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return metric_search.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.round_trip(table(spark, sf_dir, "documents"), piece_sampling.Params(tokenizer_path("piece_bpe_32k.model")))


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.compression_bands(table(spark, sf_dir, "documents"))


def op10_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_suffix_dedup, op4_preference_formatting, op5_page_text, op6_language_id, op7_mtree_top_k, op8_piece_sampling, op9_compression_bands, op10_simhash_anchors, op11_conversation_repair, op12_hard_negatives, op13_kneser_ney, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op4_preference_formatting": preferences.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
