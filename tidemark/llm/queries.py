"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, media_chunks, packing, quality, secret_scan, simhash, token_counts, token_output, url_rules
from tidemark.llm.common import bucket_of, hash_cut, hash_of, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents.

    A doc_id labelled more than once has its least label. A null doc_id is never learned from and counts as held out.
    Null and empty texts are scored as texts without words; repeated rows stay; no rows give no rows.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = bucket_of("doc_id", 5)
    # The sample is drawn among labels first, so that only its texts move.
    known = labels.where("quality is not null").where(fold != 0).groupBy("doc_id").agg(F.min("quality").alias("label"))
    cut = hash_cut(known, ["doc_id"], sample)
    some = known.where(hash_of(["doc_id"]) <= (-1 if cut is None else cut))
    model = quality.train(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label"), sample)
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "text")
    return quality.score(rows, model)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As token_counts.count_tokens, over documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def language_model(docs: DataFrame):
    """A network fitted to rows with a lang whose fold is not 1; None where there are none."""
    return language_id.train(docs.where(bucket_of("doc_id", 3) != 1).select("text", "lang"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents; und, 0 where text is null or has no letter.

    A null doc_id is never learned from and counts as held out. Repeated rows stay; no rows give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    network = language_model(docs)
    held = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(True))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), network).drop("text")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As secret_scan.report, over documents.

    documents names one origin, source, which stands for the owner; an owner's documents of one language stand for
    a repository.
    """
    docs = table(spark, sf_dir, "documents")
    return secret_scan.report(docs.select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repo")))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As media_chunks.media_columns, over documents."""
    return media_chunks.media_columns(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As url_rules.filter_urls with the rules of the module, over pages."""
    return url_rules.filter_urls(table(spark, sf_dir, "pages"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As token_output.read_index, over the written ids of documents."""
    segments, dictionary = token_output.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_output.read_index(segments, dictionary)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As decontaminate.contaminated, over documents and benchmark."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As simhash.groups, over documents."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As packing.pack_documents, over documents."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_quality": op1_quality,
        "op2_token_counts": op2_token_counts,
        "op3_language_id": op3_language_id,
        "op4_secrets": op4_secrets,
        "op5_media": op5_media,
        "op6_urls": op6_urls,
        "op7_token_output": op7_token_output,
        "op8_decontamination": op8_decontamination,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_urls": url_rules.URL_SQL}
