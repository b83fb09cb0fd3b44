"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP6_SQL, op6_chat_format
from .crosstoken import op12_cross_tokens
from .decontaminate import op7_lsi_decontaminate
from .langid import op8_ecoc_langid
from .lmscore import op11_attention_scores
from .mtree import OP5_SQL, op5_mtree_topk
from .neardup import OP3_SQL, op3_minhash_neardup
from .packing import op4_best_fit_packing
from .periodic import op13_periodic_runs
from .pii import op2_semicrf_pii
from .secrets import op1_secret_links
from .sharding import op10_ring_shards
from .urls import op9_url_rules

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_links, op2_semicrf_pii, op3_minhash_neardup, op4_best_fit_packing, op5_mtree_topk,
        op6_chat_format, op7_lsi_decontaminate, op8_ecoc_langid, op9_url_rules, op10_ring_shards,
        op11_attention_scores, op12_cross_tokens, op13_periodic_runs,
    )
}
ORACLES = {"op3_minhash_neardup": OP3_SQL, "op5_mtree_topk": OP5_SQL, "op6_chat_format": OP6_SQL}
