"""Set operations and the joins that have their meaning."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F


def overlap_counts(texts: dict[str, DataFrame]) -> DataFrame:
    """(sets, n): distinct values shared by each pair of one-column sets and by all of them, in one pass.

    The values are tagged and grouped once, in place of an intersection for
    each pair."""
    parts = [df.toDF("value").where("value is not null").distinct().withColumn("name", F.lit(k)) for k, df in texts.items()]
    tagged = parts[0]
    for p in parts[1:]:
        tagged = tagged.unionByName(p)
    held = tagged.groupBy("value").agg(F.collect_set("name").alias("held"))
    wanted = [*combinations(texts, 2), *([tuple(texts)] if len(texts) > 2 else [])]
    counts = held.agg(*(F.count_if(F.size(F.array_intersect("held", F.array(*map(F.lit, w)))) == len(w)).alias("&".join(w)) for w in wanted))
    return counts.unpivot([], ["&".join(w) for w in wanted], "sets", "n")


def union_counts(texts: dict[str, DataFrame]) -> DataFrame:
    """One row: distinct values of all sets together, and how many more the sets hold one by one."""
    parts = [df.toDF("value").where("value is not null").distinct() for df in texts.values()]
    tagged = parts[0]
    for p in parts[1:]:
        tagged = tagged.unionByName(p)
    per = tagged.groupBy("value").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("union_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_across"))


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, copies counted; none where both are equal."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def without_either(df: DataFrame, keys: DataFrame, on: list[str], others: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows whose ``on`` isn't among ``keys`` and whose ``key`` isn't among
    ``others``: two anti joins on equality, as a join on "or" would compare all rows."""
    return df.join(keys.select(*on).distinct(), on, "left_anti").withColumn(name, key).join(others.select(name).distinct(), name, "left_anti").drop(name)


def those_in(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def unnested(df: DataFrame, columns: list[str], separator: str = "|") -> DataFrame:
    """One row for each place of several separated lists, read side by side."""
    split = {c: F.split(F.col(c), f"\\{separator}") for c in columns}
    rows = df.withColumns(split).withColumn("_z", F.explode(F.arrays_zip(*columns)))
    return rows.withColumns({c: F.col(f"_z.{c}") for c in columns}).drop("_z")
