"""Splits, samples, oversampling and weights, without a random state: a row's
place comes from a hash of its key, so every run and every partitioning gives
the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import LABELS

PARTS = (("train", 0.70), ("val", 0.15), ("test", 0.15))


def hash_key(key: str | Column, seed: int = 42) -> Column:
    """A hash that SQL engines share: MD5 of the key and the seed."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def stratified_split(df: DataFrame, key: str, labels: tuple[str, ...] = LABELS, parts=PARTS, seed: int = 42) -> DataFrame:
    """Adds ``split``: within each combination of labels (null as 0) the shares hold to a row.

    An iterative stratifier would depend on a random state; this keeps its aim, the
    same label shares in all parts, and is the same every time.  Each combination
    rounds its parts' ends by an offset of its own, between 0 and 1 by hash, so
    those of one or a few rows come to every part by its share.  Combinations
    are many and each is ranked apart; the hot one is salted: ranks are counted
    within 4,096 hash ranges and put together."""
    combination = F.concat_ws("", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in labels))
    offset = F.conv(F.substring(hash_key(F.col("_c"), seed), 1, 4), 16, 10).cast("double") / 65536
    return _salted(df.withColumn("_c", combination), key, "_c", parts, seed, offset).drop("_c")


def _salted(df: DataFrame, key: str, stratum: str, parts, seed: int, offset: Column | None = None) -> DataFrame:
    """The split for strata of any size: no window holds more than about a 4,096th
    of one.  ``offset`` is what a part's end is rounded by, a half if None."""
    rows = df.withColumn("_h", hash_key(key, seed)).withColumn("_s", F.substring("_h", 1, 3))
    counts = rows.groupBy(stratum, "_s").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(stratum).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "_n": F.sum("_m").over(Window.partitionBy(stratum))}).drop("_m")
    inside = F.row_number().over(Window.partitionBy(stratum, "_s").orderBy("_h", key))
    ranked = rows.withColumn("_i", inside).join(counts, [stratum, "_s"]).withColumn("_r", F.col("_i") + F.col("_before"))
    at, out = 0.0, F.lit(parts[-1][0])
    cuts = []
    for name, share in parts[:-1]:
        at += share
        cuts.append((name, round(at, 6)))
    for name, cut in reversed(cuts):
        out = F.when(F.col("_r") <= F.floor(F.col("_n") * cut + (0.5 if offset is None else offset)), name).otherwise(out)
    return ranked.withColumn("split", out).drop("_h", "_s", "_before", "_n", "_i", "_r")


def random_split(df: DataFrame, key: str, parts=PARTS, seed: int = 42) -> DataFrame:
    """Adds ``split`` of exact sizes, without regard to labels."""
    return _salted(df.withColumn("_c", F.lit("")), key, "_c", parts, seed).drop("_c")


def split_checks(df: DataFrame, key: str, labels: tuple[str, ...] = LABELS, parts=PARTS) -> DataFrame:
    """(check, passed): parts disjoint and whole, and every label in every part."""
    per = df.groupBy(key).agg(F.count_distinct("split").alias("n"), F.count_if(F.col("split").isNull()).alias("none"))
    whole = per.agg((F.count_if(F.col("n") > 1) == 0).alias("disjoint"), (F.count_if(F.col("none") > 0) == 0).alias("complete"))
    present = df.agg(*(((F.count_if((F.col("split") == p) & (F.col(c) == 1)) > 0)).alias(f"{c}_in_{p}") for c in labels for p, _ in parts))
    return whole.unpivot([], whole.columns, "check", "passed").unionByName(present.unpivot([], present.columns, "check", "passed"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same every time."""
    return df.orderBy(hash_key(key, seed), key).limit(n)


def oversampled(df: DataFrame, key: str, multipliers: dict[str, float], seed: int = 42) -> DataFrame:
    """All rows and, of each label, as many of its positives again as make
    ``multiplier`` times their number: ``copy`` is 0 for the rows as they are,
    then 1, 2, ...  Whole multiples copy every positive; the rest goes to the
    first by hash."""
    out = df.withColumns({"copy": F.lit(0), "for_label": F.lit("")})
    for k, (label, m) in enumerate(multipliers.items()):
        positives = df.where(F.col(label) == 1)
        whole, part = int(m - 1), (m - 1) - int(m - 1)
        more = positives.withColumns({"copy": F.explode(F.sequence(F.lit(1), F.lit(whole))), "for_label": F.lit(label)}) if whole >= 1 else None
        if part > 1e-9:
            placed = random_split(positives, key, (("more", part), ("rest", 1 - part)), seed + k).where("split = 'more'").drop("split")
            placed = placed.withColumns({"copy": F.lit(whole + 1), "for_label": F.lit(label)})
            more = placed if more is None else more.unionByName(placed)
        if more is not None:
            out = out.unionByName(more)
    return out


def class_weights(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(label, weight_0, weight_1): balanced weights n / (2 x the class's number)."""
    n = F.count("*")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("y")) for c in labels))).alias("x")).select("x.*")
    return long.groupBy("label").agg(
        F.round(n / (2 * F.nullif(F.count_if(F.col("y") == 0), F.lit(0))), 6).alias("weight_0"), F.round(n / (2 * F.nullif(F.count_if(F.col("y") == 1), F.lit(0))), 6).alias("weight_1"))


def sample_weight(multipliers: dict[str, float]) -> Column:
    """The greatest multiplier of a row's labels, 1 at least."""
    return F.greatest(F.lit(1.0), *(F.when(F.col(c) == 1, F.lit(float(m))).otherwise(1.0) for c, m in multipliers.items()), F.lit(1.0))
