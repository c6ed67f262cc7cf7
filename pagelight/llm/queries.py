"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, embed_dedup, filter_audit, fingerprints, html_text, jaccard_join, licenses, media, packing, pieces, quality, suffix_dedup, tokenfile
from .common import table
from .tokens import vocabulary


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered licence templates of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, its language's limit, and the decision."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.best_fit(table(spark, sf_dir, "documents"), vocabulary())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as wavelet matrices and read back."""
    return tokenfile.read(tokenfile.write(table(spark, sf_dir, "documents"), vocabulary()))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between embeddings of a label."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document an earlier document holds too, in strings of 50 bytes or more."""
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by shared five-word shingles."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in subword pieces and back."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as baseline JPEG, read back: digests, dimensions, thumbnail hashes."""
    return media.features(media.store(table(spark, sf_dir, "documents")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language differ in their terms, and by which."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle trees of every text and its edited text, and their likeness."""
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_embeddings": op5_embeddings,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_jaccard": op7_jaccard,
    "op8_html_text": op8_html_text,
    "op9_pieces": op9_pieces,
    "op10_media": op10_media,
    "op11_divergence": op11_divergence,
    "op12_fingerprints": op12_fingerprints,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op5_embeddings": embed_dedup.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op7_jaccard": jaccard_join.SQL,
    "op11_divergence": divergence.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
