"""The corpus pipeline: language, near copies, benchmark passages, secrets, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, packing, secret_scan, simhash
from tidemark.llm.common import materialize, release, table, unused
from tidemark.llm.queries import language_model, tokenizer_path

#: A document whose best language has a smaller share of its bytes is rejected, as is one without a letter.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter and a language that holds LEAST_SHARE of its bytes or more, by language_id.predict.

    Null, empty and letterless texts go. Where no row has a language to learn from, all others stay. Repeated rows
    and null ids stay as they are.
    """
    network = language_model(docs)
    lang, share = unused("lang", docs.columns), unused("share", docs.columns)
    judged = language_id.predict(docs, network or language_id.Network([""]), out=(lang, share))
    least = LEAST_SHARE if network else 0.0
    return judged.where((F.col(lang) != language_id.UNKNOWN) & (F.col(share) >= least)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, as simhash.keep_one."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no item of benchmark, as decontaminate.clean."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced, as secret_scan.redact; source is the owner, its texts of a language a repository."""
    return secret_scan.redact(docs, repo=F.concat_ws("/", "source", "lang"), owner="source")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places, as packing.pack_documents."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Models, tokenizers and fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
