"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    alignment,
    bitplanes,
    bpe,
    jaccard_join,
    language_id,
    merkle_manifest,
    mixing,
    quality_classifier,
    quality_rules,
    secret_scans,
    token_counts,
    topk_search,
    toxicity,
)
from fleetlens.session import scratch_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_embeddings(_table(spark, sf_dir, "embeddings"))


def token_digests(rows: DataFrame) -> DataFrame:
    """Counts and digests of a table with ``ids`` and ``decoded``."""
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.round_trip(_table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    bitplanes.write_ids(_table(spark, sf_dir, "documents"), folder)
    return bitplanes.document_index(spark, folder)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.find_secrets(_table(spark, sf_dir, "documents"))
    base = [*secret_scans.KINDS]
    base_text = secret_scans.spans_text(secret_scans.all_spans(base))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(base_text.cast("binary"), 256).alias("base_sha256"),
        secret_scans.spans_text(secret_scans.all_spans([*base, "random"])).alias("spans"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(_table(spark, sf_dir, "documents"))


def without_line_feeds(docs: DataFrame) -> Column:
    """The tampered text of every second document by the checksum of its id."""
    chosen = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(chosen, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    proofs = merkle_manifest.prove(merkle_manifest.manifest(docs, without_line_feeds(docs)))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_topk_search,
        op3_bpe_round_trip,
        op4_toxicity,
        op5_bit_planes,
        op6_secret_scans,
        op7_language_id,
        op8_mixing,
        op9_jaccard_join,
        op10_token_counts,
        op11_quality_classifier,
        op12_alignment,
        op13_merkle_manifest,
    )
}
