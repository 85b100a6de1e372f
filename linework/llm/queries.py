"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from linework.llm import decontaminate, jaccard, licenses, mixing, packing, quality, repeats, resampling, sharding, toxicity, urlfilter, warc, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_warc": warc.op2_warc,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_licenses": licenses.op4_licenses,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_urlfilter": urlfilter.op7_urlfilter,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_repeats": repeats.op10_repeats,
    "op11_resampling": resampling.op11_resampling,
    "op12_whitening": whitening.op12_whitening,
    "op13_packing": packing.op13_packing,
}

ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op3_jaccard": jaccard.OP3_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_urlfilter": urlfilter.OP7_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_resampling": resampling.OP11_SQL,
}
