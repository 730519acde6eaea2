"""The queries of this subpackage: name to function of (session, folder), and the SQL of those that SQL can express."""

from __future__ import annotations

from harrow.llm.chat import OP1_SQL, op1_chat
from harrow.llm.language import op7_language
from harrow.llm.neighbours import op6_neighbours
from harrow.llm.ngram_join import op2_ngram_join
from harrow.llm.ngram_lm import op3_ngram_lm
from harrow.llm.packing import op9_packing
from harrow.llm.pieces import op10_pieces
from harrow.llm.quality import op8_quality
from harrow.llm.secrets import op4_secrets
from harrow.llm.vector_dedup import OP5_SQL, op5_embedding_dedup

QUERIES = {
    "op1_chat": op1_chat,
    "op2_ngram_join": op2_ngram_join,
    "op3_ngram_lm": op3_ngram_lm,
    "op4_secrets": op4_secrets,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_neighbours": op6_neighbours,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_pieces": op10_pieces,
}
ORACLE_SQL: dict[str, str] = {"op1_chat": OP1_SQL, "op5_embedding_dedup": OP5_SQL}
