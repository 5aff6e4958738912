"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, filter_audit, html_extract, language, licenses, merkle, neighbours, packing, quality, sentencepiece, simhash, token_files, warc

QUERIES = {
    "op1_nearest_neighbours": neighbours.query,
    "op2_simhash": simhash.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_best_fit_packing": packing.query,
    "op5_html_extract": html_extract.query,
    "op6_sentencepiece": sentencepiece.query,
    "op7_license_scan": licenses.query,
    "op8_quality": quality.query,
    "op9_warc": warc.query,
    "op10_language_id": language.query,
    "op11_merkle_manifest": merkle.query,
    "op12_token_files": token_files.query,
    "op13_filter_audit": filter_audit.query,
    "language_id_pages": language.pages_query,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_license_scan": licenses.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
