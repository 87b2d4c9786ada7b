"""The corpus queries that __spark_entry__.py registers, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import (
    additive_ann,
    license_notices,
    mixing,
    packing,
    pii_bootstrap,
    quality_rules,
    quote_links,
    resampling,
    secret_crf,
    simhash,
    target_resampling,
    token_alignment,
    word_bpe,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": resampling.op1_importance_resampling,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_secret_crf": secret_crf.op3_secret_crf,
    "op4_license_notices": license_notices.op4_license_notices,
    "op5_quote_links": quote_links.op5_quote_links,
    "op6_quality_divergence": quality_rules.op6_quality_divergence,
    "op7_pii_bootstrap": pii_bootstrap.op7_pii_bootstrap,
    "op8_poisson_mixing": mixing.op8_poisson_mixing,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_additive_ann": additive_ann.op10_additive_ann,
    "op11_word_bpe": word_bpe.op11_word_bpe,
    "op12_target_resampling": target_resampling.op12_target_resampling,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op5_quote_links": quote_links.OP5_SQL,
    "op8_poisson_mixing": mixing.OP8_SQL,
}
