"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import oracles
from quire.llm.collocations import collocations
from quire.llm.html_extract import html_extract
from quire.llm.jaccard import ngram_jaccard_join
from quire.llm.license_scan import license_scan
from quire.llm.line_dedup import line_dedup
from quire.llm.media_columns import media_columns, media_features, text_media
from quire.llm.quality_classifier import quality_classifier
from quire.llm.quality_rules import quality_rules
from quire.llm.secret_scan import secret_scan
from quire.llm.sentencepiece_codec import sentencepiece_digests
from quire.llm.source_mix import mix_sources
from quire.llm.toxicity import toxicity
from quire.llm.whitening import whiten


def model_file() -> str:
    """The vocabulary file of the encoding queries; the variable QUIRE_PIECE_MODEL names another one."""
    import public_tokenizers

    return os.environ.get("QUIRE_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the texts they decode to."""
    return sentencepiece_digests(table(spark, sf_dir, "documents"), model_file())


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingle sets of all documents, linked at 85 %."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), ngram=4, num=85, den=100)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as 8-bit audio of an undeclared type, sniffed, and read back."""
    return media_features(media_columns(text_media(table(spark, sf_dir, "documents")), "file", "declared"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, no source or document more than twice."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), share=1.5, repeats=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_slots", "n_template")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality scores of all documents."""
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first rules over all documents."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("text", "clean_text", "lang", "source", "n_chars")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, each a version of the path source/id; the ledger is empty before."""
    found, _, _ = secret_scan(table(spark, sf_dir, "documents"), ["source", "doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of 50 words or more."""
    return line_dedup(table(spark, sf_dir, "documents"), min_words=50).select("doc_id", "text", "lines_total", "lines_removed")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by models of the labels of two thirds of the ids."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"), best=2000, least=10, cover=50)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitening components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"), components=32)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: f for k, f in globals().items() if (k.startswith("op") or k == "pipeline") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
