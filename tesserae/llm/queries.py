"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from . import hostrules, linechunks, mixing, qda, repeats, simhash, tiling, toxicity, urlfilter, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_line_dedup": linechunks.op2_line_dedup,
    "op3_quality_rules": hostrules.op3_quality_rules,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_quality": qda.op5_quality,
    "op6_decontaminate": tiling.op6_decontaminate,
    "op7_repeats": repeats.op7_repeats,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_warc": warc.op9_warc,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {
    "op1_mix": mixing.ORACLE,
    "op2_line_dedup": linechunks.ORACLE,
    "op3_quality_rules": hostrules.ORACLE,
    "op9_warc": warc.ORACLE,
}
