"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, lexical, negatives, quality
from .bpe import op7_bpe
from .chat import op5_chat
from .classifier import op6_classifier
from .lexical import op13_lexical
from .minhash import op11_minhash
from .negatives import op12_negatives
from .packing import op10_packing
from .pii import op4_pii
from .quality import op2_quality
from .simhash import op1_simhash
from .spotsigs import op9_spotsigs
from .substring import op8_substring
from .token_files import op3_token_files

QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_token_files, op4_pii, op5_chat, op6_classifier, op7_bpe, op8_substring, op9_spotsigs, op10_packing, op11_minhash, op12_negatives, op13_lexical)}
ORACLES: dict[str, str] = {"op2_quality": quality.ORACLE, "op5_chat": chat.ORACLE, "op12_negatives": negatives.ORACLE, "op13_lexical": lexical.ORACLE}
