"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, filter_audit, html_text, language_id, licenses, mixing, ngram_join, secrets, token_counts, token_files, warc

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_decontamination": decontamination.query,
    "op3_language_id": language_id.query,
    "op4_source_mixing": mixing.query,
    "op5_html_text": html_text.query,
    "op6_ngram_join": ngram_join.query,
    "op7_token_files": token_files.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_secret_scan": secrets.query,
    "op10_license_scan": licenses.query,
    "op11_filter_audit": filter_audit.query,
    "op12_warc": warc.query,
}

SQL = {
    "op2_decontamination": decontamination.SQL,
    "op4_source_mixing": mixing.SQL,
    "op6_ngram_join": ngram_join.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_warc": warc.SQL,
}
