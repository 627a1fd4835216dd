"""The corpus operators' queries and their SQL."""

from tidewire.llm.decontaminate import OP9_SQL, op9_decontaminate
from tidewire.llm.embeddings import OP7_SQL, op7_embeddings
from tidewire.llm.langid import op6_language
from tidewire.llm.licenses import op4_licenses
from tidewire.llm.linededup import op10_lines
from tidewire.llm.mixing import OP3_SQL, op3_mixing
from tidewire.llm.pagetext import OP11_SQL, op11_pages
from tidewire.llm.pii import op1_pii
from tidewire.llm.prefixtrie import OP13_SQL, op13_conversations
from tidewire.llm.quality import op8_quality
from tidewire.llm.simhash import op2_simhash
from tidewire.llm.spelling import OP12_SQL, op12_spelling
from tidewire.llm.tokens import op5_tokens

QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_licenses": op4_licenses,
    "op5_tokens": op5_tokens,
    "op6_language": op6_language,
    "op7_embeddings": op7_embeddings,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_lines": op10_lines,
    "op11_pages": op11_pages,
    "op12_spelling": op12_spelling,
    "op13_conversations": op13_conversations,
}

SQL = {"op3_mixing": OP3_SQL, "op7_embeddings": OP7_SQL, "op9_decontaminate": OP9_SQL, "op11_pages": OP11_SQL, "op12_spelling": OP12_SQL, "op13_conversations": OP13_SQL}
