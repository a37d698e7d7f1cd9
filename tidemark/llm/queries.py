"""The queries of the corpus operators and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, html_extract, language_id, media, mixing, order_minhash, pii, quality, secrets, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.query,
    "op2_html_text": html_extract.query,
    "op3_secrets": secrets.query,
    "op4_quality": quality.query,
    "op5_order_minhash": order_minhash.query,
    "op6_pii": pii.query,
    "op7_mix_sources": mixing.query,
    "op8_byte_bpe": bpe.query,
    "op9_simhash": simhash.query,
    "op10_media_columns": media.query,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op7_mix_sources": mixing.SQL,
}
