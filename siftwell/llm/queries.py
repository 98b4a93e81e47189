"""The registered queries of this package: fixed result columns from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import MinHash

    return MinHash(shingle=3, percent=85).components_of(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import LicenseScan

    return LicenseScan().scan(table(spark, sf_dir, "documents"))


def _remainder(n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_ensemble import RuleEnsemble

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = RuleEnsemble().fit(docs, table(spark, sf_dir, "labels").filter(_remainder(5) != 0))
    rows = model.score(docs.withColumn("held_out", _remainder(5) == 0))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import LanguageModel

    docs = table(spark, sf_dir, "documents")
    model = LanguageModel().fit(docs.filter(_remainder(4) != 2))
    rows = docs.select("doc_id", (_remainder(4) == 2).alias("held_out"), "text")
    return model.predict(rows).select("doc_id", "held_out", "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import LineRules

    return LineRules().verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_chars")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, pieces

    parts = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, PersonalData, span_string

    rows = PersonalData().spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(span_string("base").cast("binary"), 256).alias("base_sha256"), span_string("spans").alias("spans"))


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_stable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import StableIndex

    return StableIndex(k=20).nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_license_scan, op3_quality_classifier, op4_quality_rules, op5_best_fit_packing, op6_source_mixing, op7_language, op8_personal_data, op9_warc_zip, op10_stable_neighbours)}
