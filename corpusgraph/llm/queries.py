"""Queries of this package and the SQL that checks them, by name."""

from __future__ import annotations

from . import ann, bpe, exact_topk, lexical, merkle, minhash, mixing, pii, quality, sharding, suffixes, url_filter, warc


def queries() -> dict:
    return {
        "op1_ann": ann.op1_ann,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_sharding": sharding.op3_sharding,
        "op4_warc": warc.op4_warc,
        "op5_mixing": mixing.op5_mixing,
        "op6_bpe": bpe.op6_bpe,
        "op7_exact_topk": exact_topk.op7_exact_topk,
        "op8_quality": quality.op8_quality,
        "op9_suffixes": suffixes.op9_suffixes,
        "op10_minhash": minhash.op10_minhash,
        "op11_lexical": lexical.op11_lexical,
        "op12_merkle": merkle.op12_merkle,
        "op13_pii": pii.op13_pii,
    }


def oracle_sql() -> dict:
    return {
        "op2_url_filter": url_filter.OP2_SQL,
        "op3_sharding": sharding.OP3_SQL,
        "op4_warc": warc.OP4_SQL,
        "op7_exact_topk": exact_topk.OP7_SQL,
        "op11_lexical": lexical.OP11_SQL,
        "op12_merkle": merkle.OP12_SQL,
        "op13_pii": pii.OP13_SQL,
    }
