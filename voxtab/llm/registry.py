"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from voxtab.llm.chat_format import ORACLE_OP1, op1_chat_format
from voxtab.llm.conversation_repair import op13_repair
from voxtab.llm.decontaminate import op9_decontaminate
from voxtab.llm.language_id import op5_language_id
from voxtab.llm.mixing import op4_mixing
from voxtab.llm.quality_cnn import op10_quality
from voxtab.llm.sanitise import ORACLE_OP2, op2_pii
from voxtab.llm.setsketch import op12_minhash
from voxtab.llm.simhash import op8_simhash
from voxtab.llm.spelling import op11_spelling
from voxtab.llm.token_shards import op3_token_shards
from voxtab.llm.url_filters import ORACLE_OP6, op6_url_filters
from voxtab.llm.winnowing import op7_fingerprint

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_pii": op2_pii,
    "op3_token_shards": op3_token_shards,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_url_filters": op6_url_filters,
    "op7_fingerprint": op7_fingerprint,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_minhash": op12_minhash,
    "op13_repair": op13_repair,
}
ORACLE = {"op1_chat_format": ORACLE_OP1, "op2_pii": ORACLE_OP2, "op6_url_filters": ORACLE_OP6}
