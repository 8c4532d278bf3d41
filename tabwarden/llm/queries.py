"""The registered queries of this subpackage and their SQL, where SQL can say what they return."""

from __future__ import annotations

from .chat_format import OP9_SQL, op9_chat_format
from .divergence import OP12_SQL, op12_source_divergence
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .langid import op10_language_id
from .lexical import OP11_SQL, op11_lexical_search
from .license_scan import OP4_SQL, op4_license_scan
from .lm_scoring import op7_lm_scoring
from .near_dedup import op6_near_dedup
from .packing import op2_best_fit_packing
from .pii import op5_pii
from .sentencepiece_codec import op3_sentencepiece
from .topk import OP1_SQL, op1_exact_top_k
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_license_scan": op4_license_scan,
    "op5_pii": op5_pii,
    "op6_near_dedup": op6_near_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_warc": op13_warc,
}

ORACLE_SQL = {
    "op1_exact_top_k": OP1_SQL,
    "op4_license_scan": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_warc": OP13_SQL,
}
