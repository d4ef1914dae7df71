"""Problem 5: the best representative of each group of duplicates.

Groups are those of ``dedup``.  A row's fields fall into bundles whose parts
depend on each other and are chosen as a whole: its origin (dataset, split,
row id), its place (domain), its topic, its labels with the flags that follow
from the dataset, its text with the language, its thread with the times.  A
bundle's trust is made of its completeness, the trust in its dataset, the share
of the group's rows that agree on it, and how recent it is within the group.
The trust in a dataset is learned: how often its rows agree with what most rows
of their groups say.

A branch-and-bound search picks the bundles with the greatest trust in sum
under functional dependencies: the labels follow the dataset (what a dataset
annotates differs), so they come from a row of the origin's dataset; so does
the place where that dataset knows one; the topic belongs to a post of the
place, so it doesn't come from a row of another domain.

Before any group is gathered, only the best candidate for each value that the
dependencies see (datasets, domains) is kept, by aggregates combined on the map
side: the search loses none that could win, however large the group.  Ties go
to the smaller id.  Null, blank, "nan" and "None" are missing values; a group
that has no value for a field gets null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, dedup

LABELS = ("anger", "disgust", "fear", "joy", "sadness", "surprise")
# Spellings of the domains.
DOMAINS = {"youtube": "Youtube", "facebook": "Facebook", "twitter": "Twitter"}

# A field filled, a tenth of the dataset's trust, the whole group's agreement, the greatest recency: each outweighs the sum of the next ones over all bundles.
FILLED, TRUSTED, AGREED, RECENT = 10 << 44, 1 << 44, 1 << 40, 1 << 36


def filled(value: Column) -> Column:
    """The value without outer blanks, null where it is missing."""
    value = F.trim(F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(~F.lower(value).isin("", "nan", "none"), value)


def domain_of(value: Column) -> Column:
    """The domain by its usual spelling, null where it is missing."""
    value = filled(value)
    known = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])[F.lower(value)]
    return F.coalesce(known, F.initcap(value))


def grouped(df: DataFrame, id_col: str = "internal_id", text: str = "text", **kw) -> DataFrame:
    """The rows of all groups of two or more, with their group's ``keeper_id``."""
    pairs = common.cut(dedup.members(df, id_col, text, **kw), "members")
    both = pairs.select("keeper_id", F.col("internal_id").alias("_id")).unionByName(pairs.select("keeper_id", F.col("keeper_id").alias("_id")).distinct())
    return both.join(df, F.col("_id") == F.col(id_col)).drop("_id")


KINDS = ("origin", "labels", "place", "topic", "text", "thread")
# The columns of each bundle; those that a table lacks are left out.
BUNDLES = {
    "origin": ("source_dataset", "source_split", "source_row_id"),
    "labels": (*LABELS, "original_class", "original_love", "original_contempt", "original_enjoyment", "emonoba_disgust_assumption", "f5_eligible"),
    "place": ("domain",),
    "topic": ("topic",),
    "text": ("text", "lang"),
    "thread": ("thread_key", "commented_at", "ingested_at"),
}
_CLEANED = {c: filled for c in ("source_dataset", "source_split", "topic", "lang", "thread_key")} | {"domain": domain_of}


def bundles(df: DataFrame, kinds: tuple[str, ...] = KINDS, text: str = "text") -> dict[str, list[str]]:
    """The bundles of a table with those of their columns that it has."""
    own = {k: [text if c == "text" else c for c in BUNDLES[k]] for k in kinds}
    return {k: found for k, columns in own.items() if (found := [c for c in columns if c in df.columns])}


def trusts(same: DataFrame) -> DataFrame:
    """(dataset, trust): in tenths, how many of a dataset's rows say of labels,
    place and topic what most rows of their group say.  A row a dataset."""
    some = same.where("kind in ('labels', 'place', 'topic') and complete > 0")
    votes = some.groupBy("keeper_id", "kind", "value").agg(F.sum("n").alias("n"))
    top = votes.groupBy("keeper_id", "kind").agg(F.max_by("value", F.struct("n", "value")).alias("top"))
    both = some.join(top, ["keeper_id", "kind"])
    return both.groupBy("dataset").agg(F.floor(10 * F.sum(F.when(F.col("value") == F.col("top"), F.col("n")).otherwise(0)) / F.sum("n")).alias("trust"))


def candidates(rows: DataFrame, id_col: str = "internal_id", kinds: tuple[str, ...] = KINDS, text: str = "text") -> DataFrame:
    """(keeper_id, kind, dataset, domain, rows, score, row_id, value): the best
    candidate of each bundle, dataset and (of places and topics) domain of a
    group, and for how many rows it stands; ``value`` is its fields as JSON, times as text."""
    recent = F.coalesce(F.unix_micros("ingested_at"), F.lit(0)) if dict(rows.dtypes).get("ingested_at") == "timestamp" else F.coalesce(F.unix_seconds(F.col("ingested_at").cast("timestamp")), F.lit(0))
    types = dict(rows.dtypes)

    def field(c: str) -> Column:
        if c == text:  # as it stands, but for blank ones, which are missing
            return F.when(filled(F.col(c)).isNotNull(), F.col(c)).alias(c)
        if c in _CLEANED:
            return _CLEANED[c](F.col(c)).alias(c)
        return (F.col(c).cast("string") if types[c].startswith("timestamp") else F.col(c)).alias(c)

    fields = {kind: [field(c) for c in columns] for kind, columns in bundles(rows, kinds, text).items()}
    domain = domain_of(F.col("domain")) if "domain" in types else F.lit(None).cast("string")
    parts = []
    for kind, columns in fields.items():
        value = F.to_json(F.struct(*columns))
        complete = sum(c.isNotNull().cast("int") for c in columns)
        own = domain if kind in ("place", "topic") else F.lit(None).cast("string")
        parts.append(F.struct(F.lit(kind).alias("kind"), value.alias("value"), complete.alias("complete"), own.alias("domain")))
    seen = rows.select("keeper_id", F.col(id_col).alias("row_id"), F.coalesce("source_dataset", F.lit("")).alias("dataset"), recent.alias("recent"), F.explode(F.array(*parts)).alias("p"))
    same = seen.groupBy("keeper_id", "p.kind", "dataset", "p.domain", "p.value").agg(
        F.max("p.complete").alias("complete"), F.max("recent").alias("recent"), F.min("row_id").alias("row_id"), F.count("*").alias("n"))
    same = common.cut(same, "bundles")
    whole = same.groupBy("keeper_id", "kind").agg(F.sum("n").alias("all"), F.min("recent").alias("oldest"), F.max("recent").alias("newest"))
    # whole numbers, which sum exactly: the share of rows that agree and the place between the oldest and the newest are rounded down
    age = F.when(F.col("newest") > F.col("oldest"), (F.col("recent") - F.col("oldest")) / (F.col("newest") - F.col("oldest"))).otherwise(0.0)
    score = F.col("complete") * F.lit(FILLED) + F.coalesce("trust", F.lit(0)) * F.lit(TRUSTED) + F.floor(F.col("n") * F.lit(float(AGREED)) / F.col("all")) + F.floor(age * F.lit(float(RECENT)))
    scored = same.join(whole, ["keeper_id", "kind"]).join(trusts(same), "dataset", "left").withColumn("score", score.cast("long"))
    best = F.max_by(F.struct("score", "row_id", "value"), F.struct("score", -F.col("row_id")))
    best = scored.groupBy("keeper_id", "kind", "dataset", "domain").agg(best.alias("b"), F.sum("n").alias("rows"))
    return best.select("keeper_id", "kind", "dataset", "domain", "rows", "b.score", "b.row_id", "b.value")


def search(options: dict[str, list[tuple]]) -> dict[str, tuple]:
    """The consistent choice of bundles of the greatest trust.  Options are
    (score, row id, dataset, value) and, of places and topics, the domain, one
    list for each kind."""
    order = {k: sorted(options.get(k, []), key=lambda o: (-o[0], o[1])) for k in KINDS}
    bound = [sum(order[k][0][0] for k in KINDS[n:] if order[k]) for n in range(len(KINDS) + 1)]
    placed = {o[2] for o in order["place"] if len(o) > 4 and o[4] is not None}  # datasets that know a domain
    best: tuple[float, list] = (float("-inf"), [])

    def allowed(kind: str, o: tuple, chosen: list) -> bool:
        origin = chosen[0] if chosen else None
        if kind == "labels":
            return origin is None or o[2] == origin[2]
        if kind == "place" and len(o) > 4:
            return origin is None or origin[2] not in placed or o[2] == origin[2]
        if kind == "topic" and len(o) > 4:
            place = chosen[KINDS.index("place")]
            return place is None or None in (o[4], place[4]) or o[4] == place[4]
        return True

    def branch(n: int, score: float, chosen: list) -> None:
        nonlocal best
        if score + bound[n] <= best[0]:
            return
        if n == len(KINDS):
            best = (score, chosen)
            return
        kind = KINDS[n]
        some = [o for o in order[kind] if allowed(kind, o, chosen)]
        for o in some:
            branch(n + 1, score + o[0], [*chosen, o])
        if not order[kind] or (kind == "topic" and not some):  # no topic belongs to the place
            branch(n + 1, score, [*chosen, None])

    branch(0, 0.0, [])
    return {k: o for k, o in zip(KINDS, best[1]) if o is not None}


def choices(options: DataFrame) -> DataFrame:
    """(keeper_id, copies, lacking, domains, origin, labels, place, topic, text,
    thread): the chosen bundles as JSON; how many rows the group has, how many
    of them lack a domain, and how many domains the others name."""
    option = F.struct("kind", "score", "row_id", "dataset", "value", "domain", "rows")
    groups = options.groupBy("keeper_id").agg(F.collect_list(option).alias("options"))
    schema = pa.schema([("keeper_id", pa.int64()), ("copies", pa.int64()), ("lacking", pa.int64()), ("domains", pa.int64()), *((k, pa.string()) for k in KINDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keeper, own in zip(common.column(batch, "keeper_id"), common.column(batch, "options")):
                by: dict[str, list] = {}
                rows: dict[str, int] = {}
                for o in own:
                    by.setdefault(o["kind"], []).append((o["score"], o["row_id"], o["dataset"], o["value"], o["domain"]))
                    rows[o["kind"]] = rows.get(o["kind"], 0) + o["rows"]
                lacking = sum(o["rows"] for o in own if o["kind"] == "place" and o["domain"] is None)
                domains = len({o["domain"] for o in own if o["kind"] == "place"} - {None})
                won = search(by)
                out.append((keeper, max(rows.values()), lacking, domains, *(won[k][3] if k in won else None for k in KINDS)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return groups.mapInArrow(run, "keeper_id long, copies long, lacking long, domains long, " + ", ".join(f"{k} string" for k in KINDS))


def survivors(df: DataFrame, id_col: str = "internal_id", text: str = "text", kinds: tuple[str, ...] = KINDS, **kw) -> DataFrame:
    """One record for each group of two or more: ``keeper_id``, ``copies`` and
    the chosen fields, all columns of the bundles ``kinds`` that the table has."""
    common.ship(df.sparkSession)
    own, types = bundles(df, kinds, text), {f.name: f.dataType.simpleString() for f in df.schema}
    keep = dict.fromkeys([id_col, "source_dataset", "domain", "ingested_at", *(c for columns in own.values() for c in columns)])
    groups = grouped(df, id_col, text, **kw)
    rows = common.cut(groups.select("keeper_id", *keep), "groups")
    out = choices(candidates(rows, id_col, kinds, text))
    for kind, columns in own.items():
        ddl = ", ".join(f"`{c}` {'string' if types[c].startswith('timestamp') else types[c]}" for c in columns)
        out = out.withColumn(f"_{kind}", F.from_json(kind, ddl))
    order = [k for k in ("origin", "place", "topic", "labels", "text", "thread") if k in own]
    return out.select("keeper_id", "copies", "lacking", "domains", *(F.col(f"_{k}")[c].cast(types[c]).alias(c) for k in order for c in own[k]))


def completed_domains(df: DataFrame, id_col: str = "internal_id", text: str = "text", **kw) -> DataFrame:
    """(internal_id, domain): groups in which a row lacks the domain and all others
    agree on one, with the domain of the place that the search chose."""
    found = survivors(df, id_col, text, ("origin", "labels", "place"), **kw).where("lacking > 0 and domains = 1 and domain is not null")
    return found.select(F.col("keeper_id").alias("internal_id"), "domain")
