"""The numbered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import decontaminate, extract, langid, media, minhash, mixing, negatives, quality, secrets, tokenstore, toxicity, warc, whitening

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_language_mixture": langid.op2_language_mixture,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_near_duplicates": minhash.op4_near_duplicates,
    "op5_media_columns": media.op5_media_columns,
    "op6_warc_archive": warc.op6_warc_archive,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_store": tokenstore.op8_token_store,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_main_text": extract.op10_main_text,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_quality_rules": quality.op13_quality_rules,
}

ORACLES = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op6_warc_archive": warc.OP6_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op13_quality_rules": quality.OP13_SQL,
}
