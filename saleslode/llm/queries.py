"""Registered queries of the operators and their SQL twins, where SQL can express them."""

from __future__ import annotations

from . import (
    alignment,
    bfdpacking,
    bwtmerge,
    decontamination,
    fmindex,
    gramjoin,
    kkpacking,
    licenses,
    pseudonyms,
    rendezvous,
    spotsigs,
    toxicity,
    treapsearch,
)

QUERIES = {
    "op1_gram_join": gramjoin.op1_gram_join,
    "op2_token_rows": bfdpacking.op2_token_rows,
    "op3_fingerprints": spotsigs.op3_fingerprints,
    "op4_substring_index": fmindex.op4_substring_index,
    "op5_suffix_merge": bwtmerge.op5_suffix_merge,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_licenses": licenses.op8_licenses,
    "op9_pseudonyms": pseudonyms.op9_pseudonyms,
    "op10_packing": kkpacking.op10_packing,
    "op11_rendezvous": rendezvous.op11_rendezvous,
    "op12_alignment": alignment.op12_alignment,
    "op13_treap_search": treapsearch.op13_treap_search,
}
ORACLES = {
    "op6_decontamination": decontamination.OP6_SQL,
    "op11_rendezvous": rendezvous.OP11_SQL,
    "op13_treap_search": treapsearch.OP13_SQL,
}
