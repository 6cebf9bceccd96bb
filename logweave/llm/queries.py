"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from logweave.llm import bpe, decontaminate, exact_dedup, html_extract, licenses, quality, secrets, simhash, substring_dedup, token_counts


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_quality": quality.op2_quality,
        "op3_simhash": simhash.op3_simhash,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_bpe": bpe.op6_bpe,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_html_extract": html_extract.op8_html_extract,
        "op10_license_scan": licenses.op10_license_scan,
        "op9_decontaminate": decontaminate.op9_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.OP1_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
