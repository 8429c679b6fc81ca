"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, media, mixing, packing, pii, quality, rans, repair, shallot, simhash, toxicity, url_filters, warc

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_rans": rans.op8_rans,
    "op9_pii": pii.op9_pii,
    "op10_simhash": simhash.op10_simhash,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_shallot": shallot.op12_shallot,
    "op13_byte_bpe": bpe.op13_byte_bpe,
}
SQL = {"op2_url_filters": url_filters.OP2_SQL, "op4_mixing": mixing.OP4_SQL, "op12_shallot": shallot.OP12_SQL}
