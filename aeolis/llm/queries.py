"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audit, divergence, langid, lines, mixing, near, packing, pages, passages, quality, secrets, spotsigs, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_pages": pages.op2_pages,
    "op3_passages": passages.op3_passages,
    "op4_near": near.op4_near,
    "op5_spotsigs": spotsigs.op5_spotsigs,
    "op6_mixing": mixing.op6_mixing,
    "op7_langid": langid.op7_langid,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_lines": lines.op10_lines,
    "op11_divergence": divergence.op11_divergence,
    "op12_warc": warc.op12_warc,
    "op13_audit": audit.op13_audit,
}
ORACLE_SQL = {
    "op4_near": near.ORACLE, "op9_quality": quality.ORACLE, "op10_lines": lines.ORACLE, "op11_divergence": divergence.ORACLE, "op12_warc": warc.ORACLE, "op13_audit": audit.ORACLE,
}
