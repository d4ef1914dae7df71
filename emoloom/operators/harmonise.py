"""Three differently labelled sources in one schema.

A source is a table of facts (``Source``): where its fields come from, which
rows it leaves out and by which rule.  The same facts give the harmonised
rows, the manifest of all rows and the log of transformations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import short_hash
from ..schema import HARMONISED, LABELS


@dataclass(frozen=True)
class Source:
    """``labels`` maps each label to an expression; ``excluded`` gives rules
    (reason, condition) in order: the first that holds leaves the row out."""

    name: str
    row_id: str
    text: str
    labels: dict[str, Column]
    split: Column = field(default_factory=lambda: F.lit("NONE"))
    excluded: tuple[tuple[str, Column], ...] = ()
    assumed: bool = False
    originals: dict[str, Column] = field(default_factory=dict)
    domain: Column | None = None
    topic: Column | None = None


def row_sum(columns: list[str] | tuple[str, ...]) -> Column:
    """Sum over a row, null as 0."""
    return sum((F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in columns), F.lit(0))


def multi_label(name: str = "EmoNoBa", row_id: str = "ID", split: Column | None = None) -> Source:
    """Five labels of its own; disgust isn't annotated and assumed absent.  Rows whose only label is love are left out."""
    own = {"anger": "Anger", "fear": "Fear", "joy": "Joy", "sadness": "Sadness", "surprise": "Surprise"}
    only_love = (F.col("Love") == 1) & (row_sum([*own.values()]) == 0)
    return Source(
        name, row_id, "Data", {k: F.col(v).cast("int") for k, v in own.items()} | {"disgust": F.lit(0)}, F.lit("NONE") if split is None else split,
        (("love_only", only_love),), True, {"original_love": F.col("Love").cast("long")}, F.col("Domain"), F.col("Topic"),
    )


def class_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def single_label(name: str = "UBMEC", row_id: str = "row_no") -> Source:
    """One class a row, any case; rows of other classes are left out."""
    key = class_key(F.col("classes"))
    return Source(
        name, row_id, "text", {k: (key == k).cast("int") for k in LABELS}, excluded=(("unknown_class", ~F.coalesce(key.isin(*LABELS), F.lit(False))),),
        originals={"original_class": F.col("classes")},
    )


def seven_label(name: str = "MONOVAB", row_id: str = "Unnamed: 0") -> Source:
    """Enjoyment counts as joy; rows whose only label is contempt are left out."""
    own = ("anger", "disgust", "fear", "sadness", "surprise")
    only_contempt = (F.col("contempt") == 1) & (row_sum([*own, "enjoyment"]) == 0)
    return Source(
        name, f"`{row_id}`", "comment", {k: F.col(k).cast("int") for k in own} | {"joy": F.col("enjoyment").cast("int")}, excluded=(("contempt_only", only_contempt),),
        originals={"original_contempt": F.col("contempt").cast("long"), "original_enjoyment": F.col("enjoyment").cast("long")},
    )


def reason(source: Source) -> Column:
    """Why a row is left out; null where it is kept."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(source.excluded):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _fields(source: Source) -> list[Column]:
    value = {
        "source_dataset": F.lit(source.name), "source_split": source.split, "source_row_id": F.col(source.row_id), "text": F.col(source.text),
        "emonoba_disgust_assumption": F.lit(source.assumed), "f5_eligible": F.lit(source.assumed),
        "domain": source.domain, "topic": source.topic, **source.labels, **source.originals,
    }
    return [(F.lit(None) if value.get(f.name) is None else value[f.name]).cast(f.dataType).alias(f.name) for f in HARMONISED.fields]


def harmonised(df: DataFrame, source: Source) -> DataFrame:
    """The kept rows in the common schema and column order."""
    return df.where(reason(source).isNull()).select(*_fields(source))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ordered_columns(df: DataFrame) -> DataFrame:
    return df.select(*HARMONISED.fieldNames())


def manifest(df: DataFrame, source: Source) -> DataFrame:
    """Every row with whether and why it is kept, its labels after, and the text's start."""
    why = reason(source)
    after = F.concat_ws("|", *(F.concat(F.lit(f"{k}="), source.labels[k].cast("string")) for k in LABELS))
    return df.select(
        F.lit(source.name).alias("source_dataset"), source.split.alias("source_split"), F.col(source.row_id).cast("long").alias("source_row_id"), why.isNull().alias("included"),
        F.coalesce(why, F.lit("")).alias("reason"), F.when(why.isNull(), after).otherwise("").alias("labels_after"), F.substring(F.coalesce(F.col(source.text), F.lit("")), 1, 80).alias("text_start"))


def transformation_log(manifests: DataFrame) -> DataFrame:
    """How many rows each rule of each source touched."""
    rule = F.when(F.col("included"), F.lit("mapped")).otherwise(F.col("reason"))
    return manifests.groupBy("source_dataset", rule.alias("rule")).agg(F.count("*").alias("affected"))


def with_love(df: DataFrame, annotated: str = "EmoNoBa") -> DataFrame:
    """The seventh label: 0 where the annotated source has none, null elsewhere (not annotated)."""
    return df.withColumn("love", F.when(F.col("source_dataset") == annotated, F.coalesce(F.col("original_love"), F.lit(0)).cast("int")))


def reincluded(df: DataFrame, source: Source, rule: str = "love_only") -> DataFrame:
    """The rows that one rule left out, in the common schema."""
    return df.where(reason(source) == rule).select(*_fields(source))


def sample_ids(df: DataFrame, out: str = "sample_id") -> DataFrame:
    """Ids of a source's prefix, the row id and the start of the text's SHA-1;
    where any two rows would share one, those get a number appended."""
    base = F.concat_ws("-", F.upper(F.substring("source_dataset", 1, 3)), F.coalesce(F.col("source_row_id").cast("string"), F.lit("NA")), short_hash(F.coalesce(F.col("text"), F.lit("")), 8))
    rows = df.withColumn("_base", base)
    from pyspark.sql import Window

    shared = Window.partitionBy("_base")
    number = F.row_number().over(shared.orderBy("source_split", "source_row_id"))
    return rows.withColumn(out, F.when(F.count("*").over(shared) > 1, F.concat_ws("-", "_base", number.cast("string"))).otherwise(F.col("_base"))).drop("_base")


#: Native labels and what becomes of them.
MAPPING = [
    *(("EmoNoBa", k.capitalize(), k, "direct") for k in ("joy", "surprise", "anger", "sadness", "fear")), ("EmoNoBa", "Love", None, "dropped"), ("EmoNoBa", "", "disgust", "assumed_zero"),
    *(("UBMEC", k, k, "direct") for k in LABELS),
    *(("MONOVAB", k, k, "direct") for k in ("anger", "disgust", "fear", "sadness", "surprise")), ("MONOVAB", "enjoyment", "joy", "renamed"), ("MONOVAB", "contempt", None, "dropped"),
]


def label_mapping(spark) -> DataFrame:
    return spark.createDataFrame(MAPPING, "source_dataset string, native_label string, target_label string, status string")
