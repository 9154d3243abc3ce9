"""Columns of the engine's tables, as DDL."""

TABLES = {
    "docs": "doc_id long, title string, is_finished boolean, progress int",
    "lines": "doc_id long, line_index int, is_favourite boolean",
    "tokens": "doc_id long, line_index int, token_index int, content string, surface_form_id string",
    "lemmas": "lemma_id string, spelling string, disambiguation string, reading string, main_pos string, second_pos string, third_pos string, fourth_pos string, comes_from string",
    "variants": "variant_id string, lemma_id string, spelling string, reading string, item_id long",
    "surface_forms": "surface_form_id string, variant_id string, spelling string, reading string",
    "morphemes": "variant_id string, morpheme_index int, spelling string, reading string, underlying_reading string",
    "defs": "def_id long, dict_name string, spelling string, reading string, content string, tags array<string>",
    "highlights": "content string",
    "reviews": "item_id long, review_id long, reviewed_at timestamp, grade string",
    "item_states": "item_id long, status string, difficulty double, stability double, reviewed_at timestamp, due_at timestamp, next_due timestamp",
}

#: (child table, its columns, parent table, its columns)
REFERENCES = [
    ("lines", ["doc_id"], "docs", ["doc_id"]),
    ("tokens", ["doc_id", "line_index"], "lines", ["doc_id", "line_index"]),
    ("tokens", ["surface_form_id"], "surface_forms", ["surface_form_id"]),
    ("surface_forms", ["variant_id"], "variants", ["variant_id"]),
    ("variants", ["lemma_id"], "lemmas", ["lemma_id"]),
    ("morphemes", ["variant_id"], "variants", ["variant_id"]),
]

KEYS = {
    "docs": [["doc_id"], ["title"]],
    "lines": [["doc_id", "line_index"]],
    "tokens": [["doc_id", "line_index", "token_index"]],
    "lemmas": [["lemma_id"]],
    "variants": [["variant_id"], ["lemma_id", "spelling", "reading"]],
    "surface_forms": [["surface_form_id"]],
    "morphemes": [["variant_id", "morpheme_index"]],
}
