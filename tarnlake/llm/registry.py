"""The queries of this subpackage by name, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from tarnlake.llm import decontaminate, html_extract, oracles, packing, pii, quality, secret_scan, sharding, simhash, suffix_dedup, urlfilter


def queries() -> dict:
    return {
        "op1_secrets": secret_scan.op1_secrets,
        "op2_packing": packing.op2_packing,
        "op3_sharding": sharding.op3_sharding,
        "op4_html": html_extract.op4_html,
        "op5_quality": quality.op5_quality,
        "op6_url_filter": urlfilter.op6_url_filter,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
