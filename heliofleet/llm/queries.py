"""The registered queries of this subpackage and the SQL that must give the same rows, where SQL can express it."""

from __future__ import annotations

from . import decontaminate, exact, lexical, licenses, lm, merkle, neardup, packing, quality, records, secrets, suffixes, topk

QUERIES = {f.__name__: f for f in (
    suffixes.op1_suffix_dedup, quality.op2_quality, licenses.op3_license, lm.op4_lm_score, records.op5_token_records,
    secrets.op6_secrets, decontaminate.op7_decontaminate, packing.op8_packing, neardup.op9_near_duplicates, topk.op10_topk,
    lexical.op11_lexical_search, merkle.op12_merkle_manifest, exact.op13_exact_dedup)}

ORACLES = {"op3_license": licenses.OP3_SQL, "op6_secrets": secrets.OP6_SQL, "op7_decontaminate": decontaminate.OP7_SQL,
           "op9_near_duplicates": neardup.OP9_SQL, "op10_topk": topk.OP10_SQL,
           "op11_lexical_search": lexical.OP11_SQL, "op12_merkle_manifest": merkle.OP12_SQL, "op13_exact_dedup": exact.OP13_SQL}
