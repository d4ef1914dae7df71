"""Audits: profiles, distributions and invariant checks, each one aggregate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.features import BANGLA
from ..functions.text import MENTION, URL, WS, nfc, squeeze, tokens
from ..schema import LABELS


def text_audit(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: nulls, empty and blank texts, distinct texts as they are,
    stripped and normalised, and the copies that each way of comparing leaves."""
    c = F.col(text)
    stripped = F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")
    rows = df.select(c.alias("raw"), stripped.alias("stripped"), squeeze(nfc(c)).alias("normalised"))
    out = rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("raw").isNull()).alias("nulls"), F.count_if(F.col("raw") == "").alias("empty"),
        F.count_if((F.col("raw") != "") & (F.col("stripped") == "")).alias("blank"),
        *(F.count_distinct(k).alias(f"distinct_{k}") for k in ("raw", "stripped", "normalised")))
    # a null counts as one more value of its own, so copies of null count as well
    return out.withColumns({f"duplicates_{k}": F.col("total") - F.col(f"distinct_{k}") for k in ("raw", "stripped", "normalised")})


def length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """(measure, min, max, mean, median, std, q25, q75) of characters and words, of texts that aren't null."""
    rows = df.where(F.col(text).isNotNull()).select(F.length(text).cast("long").alias("chars"), F.size(tokens(F.col(text))).cast("long").alias("words"))
    long = rows.select(F.explode(F.create_map(F.lit("chars"), "chars", F.lit("words"), "words")).alias("measure", "x"))
    p = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy("measure").agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.avg("x"), 2).alias("mean"), F.round(p[1], 2).alias("median"),
        F.round(F.stddev_samp("x"), 2).alias("std"), F.round(p[0], 2).alias("q25"), F.round(p[2], 2).alias("q75"))


def script_breakdown(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: texts of Bangla only, of both scripts, of Latin only, of neither, with a link, with a mention."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(t.rlike(BANGLA).alias("b"), t.rlike("[a-zA-Z]").alias("l"), t.rlike(URL).alias("u"), t.rlike(MENTION).alias("m"))
    b, l = F.col("b"), F.col("l")
    return rows.agg(
        F.count_if(b & ~l).alias("pure_bangla"), F.count_if(b & l).alias("mixed"), F.count_if(~b & l).alias("latin_only"), F.count_if(~b & ~l).alias("neither"),
        F.count_if("u").alias("with_url"), F.count_if("m").alias("with_mention"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def label_cardinality(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    n = sum((F.coalesce(F.col(c), F.lit(0)) for c in labels), F.lit(0))
    return df.groupBy(n.alias("labels")).agg(F.count("*").alias("n"))


def mean_labels(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    n = sum((F.coalesce(F.col(c), F.lit(0)) for c in labels), F.lit(0))
    return df.agg(F.round(F.avg(n), 4).alias("mean_labels"))


def prevalence(df: DataFrame, by: list[str] = (), labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(by…, label, positives, n, pct): the share of each label, overall or by group."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("y")) for c in labels))).alias("x")).select(*by, "x.label", "x.y")
    return long.groupBy(*by, "label").agg(F.sum("y").cast("long").alias("positives"), F.count("*").alias("n"), F.round(100 * F.sum("y") / F.count("*"), 2).alias("pct"))


def metadata_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct_values)."""
    return df.agg(*(F.count_distinct(c).alias(c) for c in columns)).unpivot([], columns, "column", "distinct_values")


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return value_counts(df.where(F.col(column).isNotNull()), column).orderBy(F.desc("n"), "value").limit(k)


def full_row_duplicates(df: DataFrame, without: list[str] = ()) -> DataFrame:
    """One row: how many rows repeat another, nulls being equal."""
    rows = df.drop(*without)
    return rows.groupBy(*rows.columns).count().agg((F.coalesce(F.sum("count"), F.lit(0)) - F.count("*")).alias("duplicates"))


def conflicting_texts(df: DataFrame, text: str = "text", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(text, n): texts that some label differs for."""
    out = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"_{c}") for c in labels))
    return out.where(reduce(lambda a, b: a | b, (F.col(f"_{c}") > 1 for c in labels))).select(text, "n")


def conflict_samples(df: DataFrame, id_col: str, text: str = "text", labels: tuple[str, ...] = LABELS, k: int = 10) -> DataFrame:
    """Of the first ``k`` conflicting texts, their rows."""
    first = conflicting_texts(df, text, labels).orderBy(text).limit(k)
    return df.join(first.select(text), text, "left_semi").select(text, id_col, *labels)


def anomalies(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: texts without any letter, texts of mixed script."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.agg(F.count_if(~t.rlike(r"\p{L}")).alias("no_letter"), F.count_if(t.rlike(BANGLA) & t.rlike("[a-zA-Z]")).alias("mixed_script"))


def unlabelled(df: DataFrame, by: str = "source_dataset", labels: tuple[str, ...] = LABELS) -> DataFrame:
    n = sum((F.coalesce(F.col(c), F.lit(0)) for c in labels), F.lit(0))
    return df.where(n == 0).groupBy(by).agg(F.count("*").alias("n"))


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, passed, violations): a rule passes where it holds, or isn't null, for all rows."""
    counted = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    return counted.unpivot([], list(rules), "check", "violations").select("check", (F.col("violations") == 0).alias("passed"), "violations")


def harmonised_rules(labels: tuple[str, ...] = LABELS) -> dict[str, Column]:
    binary = {f"binary_{c}": F.col(c).isin(0, 1) for c in labels}
    one_hot = (F.col("source_dataset") != "UBMEC") | (sum((F.col(c) for c in labels), F.lit(0)) == 1)
    flagged = F.col("emonoba_disgust_assumption") == (F.col("source_dataset") == "EmoNoBa")
    return binary | {"text_present": F.col("text").isNotNull(), "single_label_one_hot": one_hot, "assumption_flagged": flagged, "assumed_disgust_zero": ~F.col("emonoba_disgust_assumption") | (F.col("disgust") == 0)}


def source_sets(groups: DataFrame, key: str, source: str) -> DataFrame:
    """(sources, groups): how many groups of two or more each exact set of sources holds."""
    sets = groups.groupBy(key).agg(F.concat_ws("+", F.array_sort(F.collect_set(source))).alias("sources"), F.count("*").alias("n"))
    return sets.where("n > 1").groupBy("sources").agg(F.count("*").alias("groups"))


def label_order(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(label, positives, place): most frequent first, of equals the later label first."""
    from pyspark.sql import Window

    sums = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in labels)).unpivot([], list(labels), "label", "positives")
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("positives"), place.desc())).cast("long"))


def cooccurrence(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(a, b, n): rows that have both labels; the diagonal holds each label's own count."""
    cells = {(a, b): F.sum((F.col(a) == 1).cast("long") * (F.col(b) == 1).cast("long")) for a in labels for b in labels}
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(s, F.lit(0)).alias("n")) for (a, b), s in cells.items())).alias("c"))
    return row.select(F.inline("c"))


def greedy_label_order(df: DataFrame, labels: tuple[str, ...] = LABELS) -> list[str]:
    """Most frequent label first, then always the one that occurs most with those
    picked; of equals the first by name order of ``labels``.  Works on one 6 x 6 row."""
    counts = {(r.a, r.b): r.n for r in cooccurrence(df, labels).collect()}
    picked = [max(range(len(labels)), key=lambda k: (counts[labels[k], labels[k]], k))]
    while len(picked) < len(labels):
        rest = [k for k in range(len(labels)) if k not in picked]
        picked.append(max(rest, key=lambda k: (sum(counts[labels[k], labels[p]] for p in picked), -k)))
    return [labels[k] for k in picked]


def _listed(words: list[str]) -> Callable[[Column], Column]:
    known = F.array(*map(F.lit, words))
    return lambda x: F.array_contains(known, x)


def lexicon_coverage(df: DataFrame, tok: Column, lists: dict[str, list[str]]) -> DataFrame:
    """(list, tokens, matched, texts, pct): how many words a list matches, in how many texts."""
    rows = df.select(tok.alias("tok"))
    n = {k: F.size(F.filter("tok", _listed(w))) for k, w in lists.items()}
    rows = rows.select(F.size("tok").alias("size"), *(c.alias(k) for k, c in n.items()))
    long = rows.select("size", F.explode(F.array(*(F.struct(F.lit(k).alias("list"), F.col(k).alias("m")) for k in lists))).alias("x")).select("size", "x.list", "x.m")
    return long.groupBy("list").agg(F.sum("size").alias("tokens"), F.sum("m").alias("matched"), F.count_if(F.col("m") > 0).alias("texts"), F.round(100 * F.sum("m") / F.greatest(F.sum("size"), F.lit(1)), 4).alias("pct"))


def class_coverage(df: DataFrame, tok: Column, lists: dict[str, list[str]]) -> DataFrame:
    """(label, texts, texts_in_class, class_size): texts with a word of the label's list, overall and among its own."""
    hit = {k: F.exists("tok", _listed(w)) for k, w in lists.items()}
    rows = df.select(tok.alias("tok"), *lists)
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("label"), h.alias("hit"), F.col(k).alias("y")) for k, h in hit.items()))).alias("x")).select("x.*")
    return long.groupBy("label").agg(F.count_if("hit").alias("texts"), F.count_if(F.col("hit") & (F.col("y") == 1)).alias("texts_in_class"), F.count_if(F.col("y") == 1).alias("class_size"))


def feature_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, min, max, mean, std, pct_zero, bad): population deviation; ``bad`` counts nulls, NaN and infinities."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("f")).select("f.*")
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))
    return long.groupBy("feature").agg(
        F.round(F.min("x"), 6).alias("min"), F.round(F.max("x"), 6).alias("max"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"),
        F.round(100 * F.count_if(F.col("x") == 0) / F.count("*"), 4).alias("pct_zero"), F.count_if(bad).alias("bad"))


def run_summary(df: DataFrame, metrics: list[str], population: bool = False) -> DataFrame:
    """(metric, mean, std, n) over runs; a sample of one has deviation 0."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in metrics))).alias("f")).select("f.*")
    std = F.stddev_pop("x") if population else F.coalesce(F.stddev_samp("x"), F.lit(0.0))
    return long.groupBy("metric").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(std, 4).alias("std"), F.count("*").alias("n"))
