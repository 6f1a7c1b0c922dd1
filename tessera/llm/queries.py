"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_codec, chat, langid, line_dedup, lloyd, merkle, packing, piece_codec, quality, secret_scan, simhash, toxicity, vafile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1,
    "op2_secrets": secret_scan.op2,
    "op3_packing": packing.op3,
    "op4_language": langid.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_quality": quality.op6,
    "op7_toxicity": toxicity.op7,
    "op8_sentencepiece": piece_codec.op8,
    "op9_topk": vafile.op9,
    "op10_chat_format": chat.op10,
    "op11_byte_bpe": byte_codec.op11,
    "op12_clusters": lloyd.op12,
    "op13_merkle": merkle.op13,
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_quality": quality.OP6_SQL,
    "op9_topk": vafile.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op12_clusters": lloyd.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
