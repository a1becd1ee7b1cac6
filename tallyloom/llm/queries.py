"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import ann, bpe, chat, infill, langid, licenses, lm, mixing, pieces, quality, sharding, simhash, whiten
from tallyloom.llm.common import table
from tallyloom.llm.oracles import ORACLES  # noqa: F401 (registered with the queries)

#: Parameters of the encoding: the rank file and the pattern that splits texts.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: The vocabulary of the piece encoding.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "op1_language_id": lambda spark, d: langid.report(table(spark, d, "documents")),
    "op2_byte_bpe": lambda spark, d: bpe.report(table(spark, d, "documents"), RANKS, PATTERN),
    "op3_chat_format": lambda spark, d: chat.report(table(spark, d, "conversations")),
    "op4_mixing": lambda spark, d: mixing.report(table(spark, d, "documents")),
    "op5_nearest_vectors": lambda spark, d: ann.report(table(spark, d, "embeddings")),
    "op6_license_scan": lambda spark, d: licenses.report(table(spark, d, "documents")),
    "op7_lm_scoring": lambda spark, d: lm.report(table(spark, d, "documents")),
    "op8_simhash": lambda spark, d: simhash.report(table(spark, d, "documents")),
    "op9_quality_rules": lambda spark, d: quality.report(table(spark, d, "documents")),
    "op10_sharding": lambda spark, d: sharding.report(table(spark, d, "documents")),
    "op11_sentencepiece": lambda spark, d: pieces.report(table(spark, d, "documents"), PIECES),
    "op12_whitening": lambda spark, d: whiten.report(table(spark, d, "embeddings")),
    "op13_fill_in_middle": lambda spark, d: infill.report(table(spark, d, "documents")),
}
