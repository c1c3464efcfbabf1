"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, divergence, fim, hamming, langid, matroska, mixing, ngramjoin, sharding, substring, tokencount, urlfilter, warc

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_warc_zstd, bpe.op2_byte_bpe, ngramjoin.op3_partenum_join, matroska.op4_matroska, hamming.op5_multi_index_hamming, mixing.op6_source_mix,
        urlfilter.op7_url_cascade, sharding.op8_jump_hash, tokencount.op9_token_counts, langid.op10_language_id, divergence.op11_source_divergence, fim.op12_fim, substring.op13_substring_dedup,
    )
}

ORACLE_SQL = {
    "op1_warc_zstd": warc.OP1_SQL, "op3_partenum_join": ngramjoin.OP3_SQL, "op5_multi_index_hamming": hamming.OP5_SQL, "op6_source_mix": mixing.OP6_SQL, "op7_url_cascade": urlfilter.OP7_SQL,
    "op8_jump_hash": sharding.OP8_SQL, "op11_source_divergence": divergence.OP11_SQL, "op12_fim": fim.OP12_SQL, "op13_substring_dedup": substring.OP13_SQL,
}
