"""Queries and reference SQL of the training-data operators."""

from __future__ import annotations

from clientlens.llm import codes, decontam, fingerprint, line_dedup, media, mixing, ngram_join, packing, periodic, pii, repeats, toxicity, warc


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_toxicity": toxicity.op2,
        "op3_packing": packing.op3,
        "op4_media_columns": media.op4,
        "op5_fingerprint": fingerprint.op5,
        "op6_mixing": mixing.op6,
        "op7_pii": pii.op7,
        "op8_ngram_join": ngram_join.op8,
        "op9_suffix_dedup": repeats.op9,
        "op10_warc": warc.op10,
        "op11_periodic": periodic.op11,
        "op12_decontam": decontam.op12,
        "op13_vector_codes": codes.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op10_warc": warc.OP10_SQL, "op12_decontam": decontam.OP12_SQL, "op13_vector_codes": codes.OP13_SQL}
