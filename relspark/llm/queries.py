"""The queries of this subpackage, by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import chat, fuzzy_hash, hilbert, html_wrapper, media, mixing, ngram_join, pieces, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_html_wrapper": html_wrapper.op4_html_wrapper,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat": chat.op6_chat,
    "op7_fuzzy_hash": fuzzy_hash.op7_fuzzy_hash,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_hilbert": hilbert.op9_hilbert,
    "op10_media": media.op10_media,
}
ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op6_chat": chat.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_hilbert": hilbert.SQL,
}
