"""The registered queries of this package and their SQL forms."""

from __future__ import annotations

from codeaudit.llm import sql
from codeaudit.llm.decontaminate import op1_decontamination
from codeaudit.llm.interaction import op11_interaction
from codeaudit.llm.jaccard import op9_jaccard
from codeaudit.llm.licenses import op4_license
from codeaudit.llm.mixing import op5_mixing
from codeaudit.llm.negatives import op13_negatives
from codeaudit.llm.passages import op8_passages
from codeaudit.llm.quality import op7_quality
from codeaudit.llm.redirects import op12_urls
from codeaudit.llm.scoring import op2_scoring
from codeaudit.llm.secrets import op6_secrets
from codeaudit.llm.sharding import op10_sharding
from codeaudit.llm.warc import op3_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_scoring": op2_scoring,
    "op3_warc": op3_warc,
    "op4_license": op4_license,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_passages": op8_passages,
    "op9_jaccard": op9_jaccard,
    "op10_sharding": op10_sharding,
    "op11_interaction": op11_interaction,
    "op12_urls": op12_urls,
    "op13_negatives": op13_negatives,
}

#: Patterns with places, min-hashes and edits of the slot map have no SQL form; tests hold
#: those queries against brute force.
SQL = {
    "op1_decontamination": sql.OP1,
    "op2_scoring": sql.OP2,
    "op3_warc": sql.OP3,
    "op5_mixing": sql.OP5,
    "op7_quality": sql.OP7,
    "op9_jaccard": sql.OP9,
    "op11_interaction": sql.OP11,
    "op12_urls": sql.OP12,
    "op13_negatives": sql.OP13,
}
