"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, packing, quality, url_filter, warc

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_quality": quality.op5_quality,
    "op6_language_id": language_id.op6_language_id,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op7_warc": warc.OP7_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
