"""Exact deduplication with provenance.

Rows are grouped by a comparison key.  A group whose label vectors agree keeps
one canonical row; one whose vectors differ is kept whole and can be dropped
later.  What a row needs to know of its group is one row a group, made by
aggregates that are combined before the shuffle, and joined back by the key's
SHA-1: a key that holds a third of the rows is never gathered in one task (the
join's skewed side is split by adaptive execution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import LABELS

# What goes first where sources and splits compete.
DATASETS = ("EmoNoBa", "UBMEC", "MONOVAB")
SPLITS = ("Train", "Val", "Test", "NONE")
LAST = 999_999_999  # the row id of a row without one


def priority(c: Column, order: tuple[str, ...]) -> Column:
    """A value's place in an order, the unlisted last."""
    out = F.lit(len(order))
    for k, v in reversed(list(enumerate(order))):
        out = F.when(c == v, k).otherwise(out)
    return out


def metadata_score(*columns: str) -> Column:
    """How many of the columns are filled; blank, "nan" and "None" aren't."""
    filled = [F.coalesce(~F.trim(F.col(c)).isin("", "nan", "None"), F.lit(False)).cast("int") for c in columns]
    return sum(filled, F.lit(0))


def annotated(df: DataFrame, key: Column, id_col: str = "internal_id", labels: tuple[str, ...] = LABELS, split_source: str = "EmoNoBa") -> DataFrame:
    """All rows with what their group is: ``group_id``, ``group_size``,
    ``n_label_vectors``, ``n_sources``, ``n_splits`` (of the source that has
    splits), ``group_type``, ``is_canonical`` and ``action``."""
    vector = F.concat_ws("", *(F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in labels))
    rows = df.withColumns({"_key": F.sha1(key.cast("binary")), "_vector": vector})
    rank = F.struct(
        (-metadata_score("domain", "topic")).alias("m"), priority(F.col("source_dataset"), DATASETS).alias("d"), priority(F.col("source_split"), SPLITS).alias("s"),
        F.coalesce(F.col("source_row_id"), F.lit(LAST)).alias("r"), F.col(id_col).alias("i"))

    def distinct(c: Column) -> Column:
        return F.size(F.collect_set(c))  # few values each: label vectors, sources, splits

    groups_ = rows.groupBy("_key").agg(
        F.count("*").alias("group_size"), distinct(F.col("_vector")).alias("n_label_vectors"), distinct(F.col("source_dataset")).alias("n_sources"),
        distinct(F.when(F.col("source_dataset") == split_source, F.coalesce("source_split", F.lit("NONE")))).alias("n_splits"), F.min(rank)["i"].alias("_best"))
    conflict, cross, split = F.col("n_label_vectors") > 1, F.col("n_sources") > 1, F.col("n_splits") > 1
    base = F.when(conflict & ~cross, "B").when(conflict & cross, "D").when(~conflict & cross, "C").when(split & ~conflict, "E").otherwise("A")
    kind = F.when(split & cross, F.concat(F.lit("E+"), base)).when(split & conflict, F.lit("E+B")).otherwise(base)
    groups_ = groups_.withColumns({"group_id": F.substring("_key", 1, 12), "group_type": F.when(F.col("group_size") > 1, kind)})
    out = rows.join(groups_, "_key").withColumn("is_canonical", F.col(id_col) == F.col("_best")).drop("_best")
    action = (
        F.when(F.col("group_size") == 1, "KEPT_AS_IS").when(F.col("n_label_vectors") > 1, "RETAINED_UNRESOLVED").when(F.col("is_canonical"), "CANONICAL_KEPT").otherwise("COLLAPSED_INTO_CANONICAL")
    )
    return out.withColumn("action", action)


def groups(rows: DataFrame) -> DataFrame:
    """One row for each group of two or more, of ``annotated`` rows."""
    some = rows.where("group_size > 1").groupBy("group_id", "_key")
    out = some.agg(
        F.first("group_type").alias("group_type"), F.first("group_size").alias("n_rows"), F.first("n_sources").cast("long").alias("n_sources"),
        F.concat_ws("|", F.array_sort(F.collect_set("source_dataset"))).alias("sources"), (F.first("n_sources") > 1).alias("is_cross_source"),
        (F.first("n_splits") > 1).alias("is_cross_split"), (F.first("n_label_vectors") > 1).alias("is_conflicting"), F.first("n_label_vectors").cast("long").alias("n_label_vectors"))
    return out.withColumn("action", F.when(F.col("is_conflicting"), "RETAINED_UNRESOLVED").otherwise("COLLAPSED")).drop("_key")


def conflict_members(rows: DataFrame, id_col: str = "internal_id") -> DataFrame:
    """The rows of conflicting groups, one row each, with the group's size: nothing is gathered."""
    some = rows.where("group_size > 1 and n_label_vectors > 1")
    return some.select("group_id", F.col("group_size").cast("long").alias("n_rows"), F.col(id_col).alias("internal_id"), "source_dataset", F.col("_vector").alias("label_vector"))


def conflicts(rows: DataFrame, id_col: str = "internal_id") -> DataFrame:
    """A report: one row for each conflicting group, its members' values joined by
    "|" in order of their id.  A line holds a whole group; where one may be
    large, ``conflict_members`` gives the same as rows."""
    some = rows.where("group_size > 1 and n_label_vectors > 1")
    members = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col("source_dataset").alias("s"), F.col("_vector").alias("v"))))
    out = some.groupBy("group_id", "_key").agg(F.count("*").alias("n_rows"), members.alias("m"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform("m", lambda x: x[name].cast("string")), "|")

    return out.select("group_id", "n_rows", joined("i").alias("internal_ids"), joined("s").alias("datasets"), joined("v").alias("label_vectors"))


def provenance(rows: DataFrame, id_col: str = "internal_id") -> DataFrame:
    """One row for each input row: its group, whether it is canonical, what was done."""
    canonical = F.when(F.col("action") == "COLLAPSED_INTO_CANONICAL", F.col("group_id"))
    status = F.when(F.col("group_size") == 1, "singleton").when(F.col("n_label_vectors") > 1, "conflicting").otherwise("identical")
    kept = F.col("is_canonical") & (F.col("action") != "RETAINED_UNRESOLVED")
    return rows.select("group_id", "group_type", F.col(id_col).alias("internal_id"), "source_dataset", "source_split", "source_row_id", kept.alias("is_canonical"), status.alias("conflict_status"), "action", canonical.alias("canonical_group_id"), F.col("_vector").alias("label_vector"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """Singletons, canonical rows and conflicting groups."""
    return rows.where("action <> 'COLLAPSED_INTO_CANONICAL'")


def in_order(df: DataFrame, id_col: str = "internal_id") -> DataFrame:
    return df.orderBy(priority(F.col("source_dataset"), DATASETS), priority(F.col("source_split"), SPLITS), F.coalesce(F.col("source_row_id"), F.lit(LAST)), id_col)


def accounting(rows: DataFrame) -> DataFrame:
    """One row: input, kept and collapsed rows, groups, and whether the sums agree."""
    out = rows.agg(
        F.count("*").alias("rows_in"), F.count_if(F.col("action") != "COLLAPSED_INTO_CANONICAL").alias("rows_out"),
        F.count_if(F.col("action") == "COLLAPSED_INTO_CANONICAL").alias("collapsed"), F.count_if(F.col("action") == "KEPT_AS_IS").alias("singletons"),
        F.count_if(F.col("action") == "CANONICAL_KEPT").alias("canonical"), F.count_if(F.col("action") == "RETAINED_UNRESOLVED").alias("retained"))
    return out.withColumn("balanced", (F.col("rows_in") == F.col("rows_out") + F.col("collapsed")) & (F.col("rows_out") == F.col("singletons") + F.col("canonical") + F.col("retained")))


def without_conflicts(df: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """``df`` without the rows of conflicting groups, by (dataset, row id) or by key: two anti joins."""
    bad = rows.where("group_size > 1 and n_label_vectors > 1")
    pairs = bad.where("source_row_id is not null").select("source_dataset", "source_row_id").distinct()
    left = df.join(pairs, ["source_dataset", "source_row_id"], "left_anti")
    return left.withColumn("_key", F.sha1(key.cast("binary"))).join(bad.select("_key").distinct(), "_key", "left_anti").drop("_key")


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by an order that leaves no ties: an aggregate
    that keeps one row a key on the map side, not a window."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(F.sha1(key.cast("binary")).alias("_key")).agg(row.alias("_row")).select("_row.*")
