"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, dedup, langid, lookalike, mixing, mojibake, overlap, pii, survivor, tokenize, truncation


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return common.read(spark, d, "harmonized_pre_dedup")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return common.read(spark, d, "documents")


def _gazetteer(spark: SparkSession, d: str) -> DataFrame:
    return common.read(spark, d, "gazetteer")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(_comments(spark, d))


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = langid.languages(_comments(spark, d))
    return rows.select("internal_id", F.explode_outer("languages").alias("x")).select("internal_id", "x.lang", F.coalesce(F.round("x.confidence", 4), F.lit(0.0)).alias("confidence"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = langid.languages(_comments(spark, d))
    return rows.select("internal_id", F.posexplode_outer("segments").alias("segment", "x")).select("internal_id", "segment", "x.lang", "x.words", F.coalesce(F.round("x.confidence", 4), F.lit(0.0)).alias("confidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(_comments(spark, d), _gazetteer(spark, d))


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(_comments(spark, d), _gazetteer(spark, d)).select("internal_id", "masked_text")


def p2_patterns(spark: SparkSession, d: str) -> DataFrame:
    _, patterns, _ = pii.finder(_comments(spark, d), _gazetteer(spark, d))
    return patterns.where(F.col("confidence") >= pii.GOOD).select("kind", "pattern", F.round("confidence", 4).alias("confidence"), "n")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_comments(spark, d))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_text(_comments(spark, d)).select("internal_id", "canonical_text")


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_members(_comments(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(_comments(spark, d)).select("internal_id")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(_comments(spark, d))


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = mojibake.garbled(_comments(spark, d)).select("internal_id").join(_comments(spark, d).select("internal_id", "source_dataset"), "internal_id")
    return rows.groupBy("source_dataset").agg(F.count("*").alias("garbled"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.completed_domains(_comments(spark, d))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(_comments(spark, d))


def _p6(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    evaluation = _comments(spark, d).where("source_split in ('Val', 'Test')")
    return evaluation, overlap.overlaps(evaluation, common.read(spark, d, "train"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)[1].select("internal_id", "sample_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(*_p6(spark, d))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)[1].select("internal_id", "sample_id", F.round("containment", 4).alias("containment"), F.round("gram_containment", 4).alias("gram_containment"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.members(_comments(spark, d))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copies(_comments(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encoded(_documents(spark, d))


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = common.read(spark, d, "mix_targets")
    return mixing.mix(mixing.sizes(_documents(spark, d)), targets), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_p9(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_documents(spark, d)).where("cut").select(F.col("id").alias("doc_id"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.truncated(_documents(spark, d)))


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each count decided."""
    return truncation.truncated(_documents(spark, d)).groupBy("evidence").agg(F.count("*").alias("documents"))


_ALL = (
    p1_found, p1_languages, p1_segments, p2_found, p2_masked, p2_patterns, p3_found, p3_canonical, p3_members, p4_found, p4_restored, p4_sources,
    p5_found, p5_survivors, p6_found, p6_report, p6_pairs, p7_found, p7_copies, p8_ids, p9_mix, p9_shares, p10_found, p10_rates, p10_evidence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
