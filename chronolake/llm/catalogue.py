"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from . import convrepair, decontaminate, htmltext, maxent, mixing, neardup, ngramjoin, quality, rules, spelling, tokenfile, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_url_filter": urlfilter.op1_url_filter,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_quality_rules": rules.op3_quality_rules,
        "op6_html_text": htmltext.op6_html_text,
        "op7_quality": quality.op7_quality,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op4_token_file": tokenfile.op4_token_file,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_lm_score": maxent.op9_lm_score,
        "op10_near_duplicates": neardup.op10_near_duplicates,
        "op11_conversation_repair": convrepair.op11_conversation_repair,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_ngram_join": ngramjoin.op13_ngram_join,
    }


def oracle_sql() -> dict:
    return decontaminate.SQL | mixing.SQL | neardup.SQL | convrepair.SQL | spelling.SQL | ngramjoin.SQL
