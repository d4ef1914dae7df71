"""Multi-label metrics and error analysis over predictions.

Wide tables have ``true_<label>``, ``pred_<label>`` and ``prob_<label>``;
``long_form`` turns them into one row a label.  Empty denominators give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import LABELS


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def long_form(df: DataFrame, keep: list[str] = (), labels: tuple[str, ...] = LABELS, prob: bool = True) -> DataFrame:
    """(keep…, label, y, p, prob)."""
    cells = [F.struct(F.lit(c).alias("label"), F.col(f"true_{c}").alias("y"), F.col(f"pred_{c}").alias("p"), *([F.col(f"prob_{c}").alias("prob")] if prob else [])) for c in labels]
    return df.select(*keep, F.inline(F.array(*cells)))


def _counts(long: DataFrame, by: list[str]) -> DataFrame:
    tp = F.count_if((F.col("y") == 1) & (F.col("p") == 1))
    return long.groupBy(*by).agg(tp.alias("tp"), F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"), F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"), F.count("*").alias("n"))


def _scores() -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def per_label(df: DataFrame, by: list[str] = (), labels: tuple[str, ...] = LABELS, digits: int = 4) -> DataFrame:
    """(by…, label, tp, fp, fn, precision, recall, f1)."""
    out = _counts(long_form(df, by, labels, prob=False), [*by, "label"])
    return out.select(*by, "label", "tp", "fp", "fn", *(F.round(c, digits).alias(k) for k, c in _scores().items()))


def overall(df: DataFrame, by: list[str] = (), labels: tuple[str, ...] = LABELS, digits: int = 4) -> DataFrame:
    """(by…, n, macro and micro F1, macro precision and recall, Hamming loss,
    Jaccard by sample, subset accuracy)."""
    by = list(by)
    if not by:  # one group, so that the two halves meet by a key
        return overall(df.withColumn("_all", F.lit(0)), ["_all"], labels, digits).drop("_all")
    counts = _counts(long_form(df, by, labels, prob=False), [*by, "label"]).select(*by, "label", "tp", "fp", "fn", *(c.alias(k) for k, c in _scores().items()))
    pooled = ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    a = counts.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), pooled.alias("micro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))
    t, p = (lambda c: F.col(f"true_{c}") == 1), (lambda c: F.col(f"pred_{c}") == 1)
    both = sum(((t(c) & p(c)).cast("int") for c in labels), F.lit(0))
    either = sum(((t(c) | p(c)).cast("int") for c in labels), F.lit(0))
    wrong = sum(((t(c) != p(c)).cast("int") for c in labels), F.lit(0))
    b = df.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(wrong) / (F.count("*") * len(labels))).alias("hamming_loss"), F.avg(ratio(both, either)).alias("jaccard"), F.avg((wrong == 0).cast("double")).alias("subset_accuracy"))
    joined = a.join(b, by)
    names = ("macro_f1", "micro_f1", "macro_precision", "macro_recall", "jaccard", "subset_accuracy")
    return joined.select(*by, "n", *(F.round(c, digits).alias(c) for c in names), F.round("hamming_loss", 6).alias("hamming_loss"))


def confusion_pairs(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(kind, a, b, n): labels that occur together; labels predicted wrongly in place of true ones."""
    t, p = (lambda c: F.col(f"true_{c}") == 1), (lambda c: F.col(f"pred_{c}") == 1)
    cells = []
    for a in labels:
        for b in labels:
            if a != b:
                cells.append(F.struct(F.lit("cooccurrence").alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(t(a) & t(b)).alias("n")))
                cells.append(F.struct(F.lit("false_positive").alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(p(a) & ~t(a) & t(b)).alias("n")))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c")).where("n > 0")


def error_rows(df: DataFrame, label: str, kind: str = "fp") -> DataFrame:
    y, p = F.col(f"true_{label}"), F.col(f"pred_{label}")
    return df.where((y == 0) & (p == 1) if kind == "fp" else (y == 1) & (p == 0))


def error_summary(df: DataFrame, label: str, patterns: dict[str, Column]) -> DataFrame:
    """(pattern, fp, fp_pct, fn, fn_pct): how many errors of a label show each pattern."""
    fp = (F.col(f"true_{label}") == 0) & (F.col(f"pred_{label}") == 1)
    fn = (F.col(f"true_{label}") == 1) & (F.col(f"pred_{label}") == 0)
    flagged = df.select(fp.alias("is_fp"), fn.alias("is_fn"), F.inline(F.array(*(F.struct(F.lit(k).alias("pattern"), c.alias("shown")) for k, c in patterns.items()))))

    def pct(kind: str) -> Column:
        return F.round(100 * F.count_if(F.col(kind) & F.col("shown")) / F.greatest(F.count_if(F.col(kind)), F.lit(1)), 1)

    return flagged.groupBy("pattern").agg(F.count_if(F.col("is_fp") & F.col("shown")).alias("fp"), pct("is_fp").alias("fp_pct"), F.count_if(F.col("is_fn") & F.col("shown")).alias("fn"), pct("is_fn").alias("fn_pct"))


def is_true(flag: Column) -> Column:
    """Whether a flag says yes: true, "True", 1 or 1.0; null doesn't."""
    return F.coalesce(F.lower(flag.cast("string")).isin("true", "1", "1.0"), F.lit(False))


def flag_sensitivity(df: DataFrame, flag: Column, label: str, digits: int = 4) -> DataFrame:
    """(flagged, n, precision, recall, f1) of a label where a flag holds and where not; a side without rows is missing."""
    rows = df.select(is_true(flag).alias("flagged"), F.col(f"true_{label}").alias("y"), F.col(f"pred_{label}").alias("p"))
    return _counts(rows, ["flagged"]).select("flagged", "n", *(F.round(c, digits).alias(k) for k, c in _scores().items()))


def errors_by(df: DataFrame, by: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(by, label, kind, n)."""
    long = long_form(df, [by], labels, prob=False)
    kind = F.when((F.col("y") == 0) & (F.col("p") == 1), "fp").when((F.col("y") == 1) & (F.col("p") == 0), "fn")
    return long.withColumn("kind", kind).where("kind is not null").groupBy(by, "label", "kind").agg(F.count("*").alias("n"))


def compared(runs: DataFrame, base: str, metric: str = "macro_f1", name: str = "run", neutral: float = 0.0005) -> DataFrame:
    """(run, metric, delta, verdict) against a base run: neutral within ``neutral``, else keep or drop."""
    value = F.max(F.when(F.col(name) == base, F.col(metric))).over(Window.partitionBy())
    delta = F.round(F.col(metric) - value, 4)
    verdict = F.when(F.abs(delta) < neutral, "neutral").when(delta > 0, "keep").otherwise("drop")
    return runs.select(name, metric, delta.alias("delta"), verdict.alias("verdict"))


def regressions(old: DataFrame, new: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(label, f1_old, f1_new, delta, rejected): a drop beyond the tolerance rejects, one of just that size doesn't."""
    both = old.select("label", F.col("f1").alias("f1_old")).join(new.select("label", F.col("f1").alias("f1_new")), "label")
    delta = F.round(F.col("f1_new") - F.col("f1_old"), 4)
    return both.select("label", "f1_old", "f1_new", delta.alias("delta"), (delta < -tolerance).alias("rejected"))


def best_run(runs: DataFrame, metric: str = "macro_f1", name: str = "run", order: str = "n") -> DataFrame:
    """The run with the greatest metric, of equals the first."""
    return runs.orderBy(F.desc(metric), order).limit(1).select(name, metric)


def kept_groups(runs: list[tuple[str, float]], base: float) -> list[str]:
    """The feature groups whose score reaches the base's."""
    return [name for name, score in runs if score >= base]
