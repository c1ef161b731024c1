"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from strike_analytics.llm import (bpe, decontam, hard_negatives, id_store, langid, outliers, phrases, pii, ppm, secret_scan,
                                  simhash, toxicity, url_filter)

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_outliers": outliers.op2_outliers,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op5_id_store": id_store.op5_id_store,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_language_id": langid.op9_language_id,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_lm_scoring": ppm.op12_lm_scoring,
    "op13_phrase_mining": phrases.op13_phrase_mining,
}

ORACLE_SQL = {
    "op8_decontaminate": decontam.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_phrase_mining": phrases.OP13_SQL,
}
