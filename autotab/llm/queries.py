"""Registered queries of the subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op7_bpe
from .chat import OP9_SQL, op9_chat
from .langid import op13_langid
from .licenses import op5_licenses
from .lm import op1_lm
from .merkle import OP12_SQL, op12_merkle
from .mixing import OP10_SQL, op10_mixing
from .negatives import OP11_SQL, op11_negatives
from .neardup import op4_dartminhash
from .quality import op3_quality
from .secret_scan import OP2_SQL, op2_secrets
from .suffix import op8_suffix_dedup
from .topk import OP6_SQL, op6_topk

QUERIES = {f.__name__: f for f in (op1_lm, op2_secrets, op3_quality, op4_dartminhash, op5_licenses, op6_topk, op7_bpe, op8_suffix_dedup, op9_chat, op10_mixing,
                                 op11_negatives, op12_merkle, op13_langid)}
ORACLE = {"op2_secrets": OP2_SQL, "op6_topk": OP6_SQL, "op9_chat": OP9_SQL, "op10_mixing": OP10_SQL, "op11_negatives": OP11_SQL, "op12_merkle": OP12_SQL}
