"""Decision thresholds by label.

One pass makes the whole sweep: each probability falls into the bucket of the
highest threshold that it reaches, buckets are counted by label, and sums from
above give the counts at every threshold.  No row meets the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import LABELS
from .metrics import long_form, ratio

LOW, HIGH = 0.05, 0.955


def grid(step: float = 0.01, digits: int | None = 4) -> list[float]:
    """Thresholds from 0.05 on, below 0.955; with ``digits`` None not rounded."""
    out, k = [], 0
    while (t := LOW + k * step) < HIGH - 1e-12:
        out.append(t if digits is None else round(t, digits))
        k += 1
    return out


def curve(df: DataFrame, step: float = 0.01, labels: tuple[str, ...] = LABELS, digits: int = 4, rounded: bool = True) -> DataFrame:
    """(label, tau, tp, fp, fn, f1) for every threshold of the grid.  With
    ``rounded`` False probabilities are compared before thresholds are rounded."""
    taus = grid(step, digits)
    spark = df.sparkSession
    # The bucket is found by arithmetic and set right by one comparison with the grid's own numbers.
    guess = F.floor((F.col("prob") - LOW) / step).cast("int")
    marks = F.array(*map(F.lit, taus if rounded else grid(step, None)))

    def at(k: Column) -> Column:
        return F.element_at(marks, F.greatest(F.least(k, F.lit(len(taus) - 1)), F.lit(0)) + 1)

    k = F.greatest(F.least(guess, F.lit(len(taus) - 1)), F.lit(-1))
    k = F.when((k + 1 < len(taus)) & (F.col("prob") >= at(k + 1)), k + 1).when((k >= 0) & (F.col("prob") < at(k)), k - 1).otherwise(k)
    rows = long_form(df, [], labels).where("prob is not null").select("label", "y", k.alias("bucket"))
    counts = rows.groupBy("label", "bucket").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    grid_ = spark.createDataFrame([(c, n, t) for c in labels for n, t in enumerate(taus)], "label string, bucket int, tau double")
    cells = grid_.join(counts, ["label", "bucket"], "left")
    below = counts.groupBy("label").agg(F.sum("pos").alias("positives"))
    above = Window.partitionBy("label").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.withColumns({"tp": F.coalesce(F.sum("pos").over(above), F.lit(0)), "fp": F.coalesce(F.sum("neg").over(above), F.lit(0))}).join(F.broadcast(below), "label", "left")
    fn = F.coalesce("positives", F.lit(0)) - F.col("tp")
    return out.select("label", "tau", "tp", "fp", fn.alias("fn"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn).alias("f1"))


def best(sweep: DataFrame, fallback: float = LOW, keep_f1: bool = True) -> DataFrame:
    """(label, tau, f1): the greatest F1, of equals the least threshold; ``fallback`` where every F1 is 0."""
    first = Window.partitionBy("label").orderBy(F.desc("f1"), "tau")
    top = sweep.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return top.select("label", F.when(F.col("f1") > 0, F.col("tau")).otherwise(fallback).alias("tau"), *([F.round("f1", 6).alias("f1")] if keep_f1 else []))


def optimised(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """The coarse sweep: 0.01 apart, 0.05 where nothing is ever right."""
    return best(curve(df, 0.01, labels), LOW)


def swept(df: DataFrame, step: float = 0.001, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """The fine sweep, of thresholds that are rounded afterwards: 0.5 where nothing is ever right."""
    return best(curve(df, step, labels, rounded=False), 0.5)


def applied(df: DataFrame, taus: dict[str, float], labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``pred_<label>`` from probabilities; a label without threshold gets 0.5."""
    return df.withColumns({f"pred_{c}": (F.col(f"prob_{c}") >= float(taus.get(c, 0.5))).cast("int") for c in labels})


def raised(taus: dict[str, float], by: dict[str, float], most: float = 0.90) -> dict[str, float]:
    """A variant: some thresholds raised, up to a bound."""
    return {k: min(most, round(t + by.get(k, 0.0), 4)) if k in by else t for k, t in taus.items()}


def fixed(tau: float = 0.5, labels: tuple[str, ...] = LABELS) -> dict[str, float]:
    return dict.fromkeys(labels, tau)


def blended(df: DataFrame, one: str, two: str, weight: float, labels: tuple[str, ...] = LABELS, out: str = "prob") -> DataFrame:
    """Soft vote: weight x first + (1 - weight) x second."""
    return df.withColumns({f"{out}_{c}": weight * F.col(f"{one}_{c}") + (1 - weight) * F.col(f"{two}_{c}") for c in labels})


def picked(df: DataFrame, prefix_of: dict[str, str], out: str = "prob") -> DataFrame:
    """Label by label the probabilities of the model that is best at it."""
    return df.withColumns({f"{out}_{c}": F.col(f"{p}_{c}") for c, p in prefix_of.items()})


def probability_profile(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(label, min, mean, max)."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"prob_{c}").alias("p")) for c in labels))))
    return long.groupBy("label").agg(F.round(F.min("p"), 6).alias("min"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.max("p"), 6).alias("max"))
