"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from graphweave.llm import ann, bpe, clustering, html_text, langid, lexical, line_dedup, media, mixing, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_additive_quantisation": ann.query,
    "op2_media_sequences": media.query,
    "op3_byte_bpe": bpe.query,
    "op4_language_codes": langid.query,
    "op5_simhash_covering": simhash.query,
    "op6_main_text": html_text.query,
    "op7_fair_mix": mixing.query,
    "op8_hilbert_shards": sharding.query,
    "op9_line_windows": line_dedup.query,
    "op10_toxicity_chain": toxicity.query,
    "op11_warc_index": warc.query,
    "op12_rotated_centroids": clustering.query,
    "op13_pair_maxscore": lexical.query,
}

SQL = {
    "op7_fair_mix": mixing.SQL,
    "op9_line_windows": line_dedup.SQL,
    "op11_warc_index": warc.SQL,
    "op12_rotated_centroids": clustering.SQL,
    "op13_pair_maxscore": lexical.SQL,
}
