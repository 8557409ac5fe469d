"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lapwing.llm import bpe, exact, html_text, licenses, lines, packing, pii, quality, simhash, toxicity


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_licenses": licenses.op5_licenses,
        "op6_simhash": simhash.op6_simhash,
        "op7_exact_dedup": exact.op7_exact_dedup,
        "op8_packing": packing.op8_packing,
        "op9_html": html_text.op9_html,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact.ORACLE}
