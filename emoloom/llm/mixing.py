"""Problem 9: mixing sources to target shares of the tokens.

The mix is the largest in which every source has its share without a document
being used more than ``max_repeats`` times: a source's expected copies a
document are (mix's tokens x share) / (source's tokens).  Systematic sampling
gives the copies: within a source, documents in order of their size (ties by a
hash and the id) have the prefix sums of the expected copies, one random
offset is added, and a copy is emitted for each integer boundary crossed.  In
order of size every run of neighbours is alike, so the shares come out close.

Documents without a source or with one that has no target are left out; so
are null and empty texts, which have no tokens.  Targets are scaled to those
of the sources present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .tokenize import token_count

SEED = 42


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every row."""
    tokens = token_count(docs.sparkSession, F.col(text), name, folder)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), tokens.cast("long").alias("tokens"))


def rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source with documents and a target: documents, tokens,
    share (scaled to sum to 1), max_repeats, rate (expected copies a document)."""
    have = sized.where("tokens > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    wanted = targets.where("target_share > 0 and source is not null and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    both = have.join(F.broadcast(wanted), "source")
    everything = Window.partitionBy()
    both = both.withColumn("share", F.col("share") / F.sum("share").over(everything))
    size = F.min(F.col("tokens") * F.col("max_repeats") / F.col("share")).over(everything)
    return both.withColumn("rate", F.least(F.col("max_repeats").cast("double"), size * F.col("share") / F.col("tokens")))


def mix(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copy): a row for each copy, ``copy`` from 1.

    A source may hold any share of the rows: the order is made by a range sort
    of all of them, ranks within a source by counts of the sorted partitions."""
    sized = common.cut(sized, "sizes")
    rate = F.broadcast(rates(sized, targets).select("source", "rate", "documents"))
    rows = sized.where("tokens > 0").join(rate, "source")
    order = ["source", "tokens", F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = common.cut(rows.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.expr("shiftright(at, 33)").alias("part")
    # Rows of a partition are numbered as they are sorted; a source's rows there are consecutive.
    counts = rows.groupBy("source", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).select("source", "part", "first", "before")
    ranked = rows.withColumn("part", F.expr("shiftright(at, 33)")).join(F.broadcast(starts), ["source", "part"])
    rank = F.col("before") + F.col("at") - F.col("first")
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor((rank + 1) * F.col("rate") + offset) - F.floor(rank * F.col("rate") + offset)).cast("int")
    out = ranked.withColumn("copies", copies).where("copies > 0")
    return out.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source of the mix: target and actual share, documents, copies, most copies of one document."""
    per = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"))
    per = per.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum("tokens").alias("tokens"))
    per = per.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    return targets.select("source", "target_share", "max_repeats").join(per, "source", "left")
