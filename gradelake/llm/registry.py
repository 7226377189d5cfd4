"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from gradelake.llm import bpe, chat, chosen_path, decontaminate, exact_dedup, language, line_dedup, ngram_join, periodic, quality, sharding, url_filter, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_sharding": sharding.op4_sharding,
    "op5_bpe": bpe.op5_bpe,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_quality": quality.op7_quality,
    "op8_chat_format": chat.op8_chat_format,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_language_id": language.op10_language_id,
    "op11_near_dedup": chosen_path.op11_near_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
SQL = exact_dedup.SQL | url_filter.SQL | chat.SQL
