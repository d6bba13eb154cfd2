"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from strandline.llm import alignment, cotraining, divergence, licenses, mixing, mpeg, ngram_join, packing, ppm, quality, quotes, repeats, warc

QUERIES = {
    "op1_differencing": packing.op1_differencing,
    "op2_radix_repeats": repeats.op2_radix_repeats,
    "op3_rtree_jaccard": ngram_join.op3_rtree_jaccard,
    "op4_line_quality": quality.op4_line_quality,
    "op5_mpeg_audio": mpeg.op5_mpeg_audio,
    "op6_quote_links": quotes.op6_quote_links,
    "op7_ppm_bytes": ppm.op7_ppm_bytes,
    "op8_cotraining": cotraining.op8_cotraining,
    "op9_seekable_warc": warc.op9_seekable_warc,
    "op10_hash_mix": mixing.op10_hash_mix,
    "op11_systolic_audit": divergence.op11_systolic_audit,
    "op12_relational_alignment": alignment.op12_relational_alignment,
    "op13_license_join": licenses.op13_license_join,
}

ORACLE = {
    "op4_line_quality": quality.SQL,
    "op6_quote_links": quotes.SQL.replace("@rows", "conversations"),
    "op10_hash_mix": mixing.SQL,
    "op11_systolic_audit": divergence.SQL,
}
