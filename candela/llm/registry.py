"""Queries and SQL of this subpackage."""

from __future__ import annotations

from candela.llm import alignment, ann, bpe, exact_dedup, html_extract, line_rules, mixing, quality, sharding, simhash, token_counts, warc, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_warc": warc.op3_warc,
    "op4_simhash": simhash.op4_simhash,
    "op5_sharding": sharding.op5_sharding,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality": quality.op8_quality,
    "op9_html": html_extract.op9_html,
    "op10_neighbours": ann.op10_neighbours,
    "op11_line_rules": line_rules.op11_line_rules,
    "op12_whitening": whitening.op12_whitening,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op11_line_rules": line_rules.OP11_SQL,
}
