"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import conversations, decontaminate, html_text, languages, licences, line_dedup, masked_lm, neighbours, ngram_join, pieces, spelling, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_pieces": pieces.query,
    "op3_warc": warc.query,
    "op4_licences": licences.query,
    "op5_decontamination": decontaminate.query,
    "op6_neighbours": neighbours.query,
    "op7_substring_dedup": line_dedup.query,
    "op8_masked_lm": masked_lm.query,
    "op9_ngram_jaccard": ngram_join.query,
    "op10_html_text": html_text.query,
    "op11_languages": languages.query,
    "op12_conversations": conversations.query,
    "op13_spelling": spelling.query,
}
SQL = {"op4_licences": licences.SQL, "op9_ngram_jaccard": ngram_join.SQL, "op12_conversations": conversations.SQL, "op13_spelling": spelling.SQL}
