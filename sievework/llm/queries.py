"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import language, licenses, media, minhash, mixing, sentencepiece_scan, sharding, suffixes, warc, winnowing

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_warc": warc.op2_warc,
    "op3_media": media.op3_media,
    "op4_mixing": mixing.op4_mixing,
    "op5_licenses": licenses.op5_licenses,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_minhash": minhash.op7_minhash,
    "op8_winnowing": winnowing.op8_winnowing,
    "op9_sentencepiece": sentencepiece_scan.op9_sentencepiece,
    "op10_language": language.op10_language,
}

SQL = sharding.SQL | warc.SQL | minhash.SQL
