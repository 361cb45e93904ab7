"""The queries of this subpackage, by name, and their SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from . import sql
from .ann import op2_nearest_neighbours
from .chat import op1_chat_tree
from .decontaminate import op4_decontaminate
from .langid import op3_language_id
from .mixing import op10_mix_sources
from .ngram_join import op7_ngram_jaccard
from .pii import op9_pii_pseudonyms
from .quality import op8_quality_resampling
from .substring import op6_substring_dedup
from .tokenstore import op5_token_store

QUERIES = {
    "op1_chat_tree": op1_chat_tree,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_store": op5_token_store,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_quality_resampling": op8_quality_resampling,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_mix_sources": op10_mix_sources,
}

#: For the rest SQL cannot say it (models, hashes, tokens) and the tests hold them against brute force.
SQL = {"op1_chat_tree": sql.OP1, "op4_decontaminate": sql.OP4, "op6_substring_dedup": sql.OP6, "op7_ngram_jaccard": sql.OP7}
