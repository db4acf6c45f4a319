"""One query per corpus operator, over its whole table, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from perilframe.llm import bpe, chat, html, licences, minhash, packing, periodic, pii, quality, sharding, vectors, warc, whitening
from perilframe.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the package that holds the files is installed on every machine."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / name)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(*quality.CONTRACT)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.grouped(table(spark, sf_dir, "documents"))


def op11_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_trial(table(spark, sf_dir, "conversations"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.found(table(spark, sf_dir, "documents"), reworded=periodic.trial))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_main_text": op2_main_text,
    "op3_near_vectors": op3_near_vectors,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_chat_parts": op11_chat_parts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_licences": licences.oracle(),
    "op3_near_vectors": vectors.ORACLE,
    "op5_quality_rules": quality.oracle(),
    "op6_warc": warc.ORACLE,
    "op11_chat_parts": chat.oracle(),
    "op12_periodic_runs": periodic.oracle(),
}
