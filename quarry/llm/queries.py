"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from quarry.llm import byte_bpe, exact_dedup, html_wrappers, language_id, near_dedup, packing, secret_scan, suffix_dedup, transport_stream, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_html_wrappers": html_wrappers.op3,
    "op4_byte_bpe": byte_bpe.op4,
    "op5_warc_revisits": warc.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_secret_scan": secret_scan.op7,
    "op8_language_id": language_id.op8,
    "op9_transport_stream": transport_stream.op9,
    "op10_packing": packing.op10,
}

SQL = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
}
