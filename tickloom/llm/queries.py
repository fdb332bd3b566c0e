"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, fingerprint, html_text, jaccard_join, line_dedup, lm_score, packing, piece_bpe, prefix_trie, token_files, topk, toxicity
from .common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op1(spark, read_table(spark, sf_dir, "documents"))


def _vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizer file that a contract names."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op4(spark, read_table(spark, sf_dir, "documents"), _vocabulary())


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op5(spark, read_table(spark, sf_dir, "documents"), _vocabulary())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op7(spark, read_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op8(spark, read_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op2(spark, read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op3(spark, read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op9(spark, read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op11(spark, read_table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op12(spark, read_table(spark, sf_dir, "documents", "lang", "text"))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.op13(spark, read_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_topk": op2_topk,
        "op3_html_text": op3_html_text,
        "op4_token_files": op4_token_files,
        "op5_bpe": op5_bpe,
        "op6_toxicity": op6_toxicity,
        "op7_fingerprint": op7_fingerprint,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_packing": op9_packing,
        "op10_lm_score": op10_lm_score,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_collocations": op12_collocations,
        "op13_piece_bpe": op13_piece_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op2_topk": topk.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_collocations": collocations.SQL}
