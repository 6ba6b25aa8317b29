"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, centroids, hyperminhash, license_scan, packing, phrases, pii, simhash, suffix_dedup, telephony, token_files, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1,
        "op2_byte_bpe": bpe.op2,
        "op3_suffix_dedup": suffix_dedup.op3,
        "op4_best_fit_packing": packing.op4,
        "op5_hyperminhash": hyperminhash.op5,
        "op6_toxicity": toxicity.op6,
        "op7_telephony_media": telephony.op7,
        "op8_token_files": token_files.op8,
        "op9_exact_top_k": topk.op9,
        "op10_personal_data": pii.op10,
        "op11_phrases": phrases.op11,
        "op12_simhash": simhash.op12,
        "op13_centroids": centroids.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op9_exact_top_k": topk.ORACLE, "op11_phrases": phrases.ORACLE, "op13_centroids": centroids.oracle()}
