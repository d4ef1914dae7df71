"""Problem 7: copies hidden by whitespace, case, punctuation or field order.

Each text becomes canonical bytes: its look-alike form in lower case without
blanks and punctuation, the fields of a "label: value" text sorted.  Copies
are found by recursive radix partitioning on these bytes: buckets of one
prefix that hold more than ``bucket_limit`` ids are split by twice as many
bytes until each fits, then counted in a trie with a terminal counter for each
distinct key.  Every batch is combined before the shuffle.  A bucket that is
one single key can't be split by more bytes: its smallest id comes from a
combined aggregate and its members are written without a shuffle, in batches,
however many there are.  The oversized prefixes stay in tables that are joined.

Not cases, hence in no group: texts that are null, have three words or fewer,
or have no letter or digit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .lookalike import Canonicaliser, confusables, is_case, pairs_of, spellings, with_forms

# Punctuation by Unicode category P, and ASCII's symbols.
_PUNCT = None
_SEPARATOR = re.compile(r"[;；|｜\n\r]+")
_FIELD = re.compile(r"\s*([^\s:：.,!?।'\"]+(?:[ \t]+[^\s:：.,!?।'\"]+){0,3})\s*[:：](?!//)")


def _punctuation() -> re.Pattern:
    global _PUNCT
    if _PUNCT is None:
        import regex

        _PUNCT = regex.compile(r"[\s\p{P}$+<=>^`|~]+")
    return _PUNCT


def fields(text: str) -> list[str] | None:
    """The fields of a text made of three "label: value" fields or more, else None."""
    if text.count(":") + text.count("：") < 3:
        return None
    found: list[str] = []
    for part in _SEPARATOR.split(text):
        if _FIELD.match(part):
            found.append(part)
        elif not part.strip():
            continue
        elif found:
            found[-1] += " " + part
        else:
            return None
    return found if len(found) >= 3 else None


class Keys:
    """Canonical bytes of texts."""

    def __init__(self, alternatives: dict[str, tuple[str, ...]] | None = None):
        self.canonical, self.strip = Canonicaliser((), alternatives), _punctuation().sub

    def plain(self, text: str, forms: list[tuple[str, str]] = ()) -> str:
        return self.strip("", self.canonical.text(text, forms).lower())

    def key(self, text: str, forms: list[tuple[str, str]] = ()) -> str:
        if parts := fields(text):
            return "\x1f".join(sorted(self.plain(p, forms) for p in parts))
        return self.plain(text, forms)


class CopyTrie:
    """A trie over ``WIDTH`` bytes a step, its branches grown only where keys part."""

    WIDTH = 16

    def __init__(self) -> None:
        self.root: dict = {}
        self.leaves: list[list] = []

    def add(self, key: bytes, ids: list[int]) -> None:
        node, at, width = self.root, 0, self.WIDTH
        while True:
            step = key[at : at + width]
            there = node.get(step)
            if there is None:
                node[step] = leaf = [key, list(ids)]
                self.leaves.append(leaf)
                return
            if type(there) is list:
                if there[0] == key:
                    there[1].extend(ids)
                    return
                node[step] = {there[0][at + width : at + 2 * width]: there}
                there = node[step]
            node, at = there, at + width

    def groups(self) -> Iterator[tuple[bytes, list[int]]]:
        return ((key, ids) for key, ids in self.leaves)


_ENTRY = pa.schema([("key", pa.binary()), ("ids", pa.list_(pa.int64()))])


def entries(df: DataFrame, id_col: str = "internal_id", text: str = "text") -> DataFrame:
    """(key, ids): canonical bytes with the ids that have them within one batch."""
    common.ship(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(confusables(df.sparkSession))
    kept = common.fresh_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = common.kept(kept, lambda: Keys(known.value))
        for batch in batches:
            own: dict[bytes, list[int]] = {}
            for i, t, forms in zip(common.column(batch, "id"), common.column(batch, "text"), common.column(batch, "forms")):
                if i is not None and is_case(t):
                    own.setdefault(to.key(t, pairs_of(forms)).encode("utf-8", "surrogatepass"), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.list_(pa.int64()))], schema=_ENTRY)

    rows = common.rows_of(df, id=F.col(id_col).cast("long"), text=F.col(text)).where("text is not null")
    return with_forms(rows, spellings(df, text), F.col("text")).mapInArrow(run, "key binary, ids array<long>")


def _prefix(depth: int) -> Column:
    return F.expr(f"substring(key, 1, {depth})")


def splits(table: DataFrame, bucket_limit: int, first: int = 8) -> list[tuple[int, DataFrame]]:
    """The oversized buckets: for each depth in bytes a table (prefix, single) of
    the prefixes that hold more ids than ``bucket_limit``, and whether they are
    one single key, which isn't split further."""
    levels: list[tuple[int, DataFrame]] = []
    within, depth = table.select("key", F.size("ids").alias("n")), first
    while True:
        big = within.groupBy(_prefix(depth).alias("prefix")).agg(F.sum("n").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        big = common.cut(big.where(F.col("n") > bucket_limit).select("prefix", (F.col("lo") == F.col("hi")).alias("single")), "big")
        if big.isEmpty():
            return levels
        levels.append((depth, big))
        within = within.join(big.where("not single"), _prefix(depth) == F.col("prefix"), "left_semi")
        depth *= 2


def _grouped(table: DataFrame, bucket_limit: int, schema: str, emit) -> DataFrame:
    """Runs ``emit(keeper, ids, first)`` over each group; ``first`` is whether
    these ids hold the group's smallest."""
    spark = table.sparkSession
    levels = splits(table, bucket_limit)
    arrow = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[] for _ in arrow])], schema=arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bucket, rows = CopyTrie(), None, []

        def out() -> None:
            for _, ids in trie.groups():
                if len(ids) > 1:
                    rows.extend(emit(min(ids), ids, True))

        for batch in batches:
            for b, key, ids in zip(common.column(batch, "bucket"), common.column(batch, "key"), common.column(batch, "ids")):
                if b != bucket:
                    out()
                    trie, bucket = CopyTrie(), b
                trie.add(key, ids)
            while len(rows) >= 10_000:
                yield batch_of(rows[:10_000])
                del rows[:10_000]
        out()
        for k in range(0, len(rows), 10_000):
            yield batch_of(rows[k : k + 10_000])

    rows, bytes_, single = table, F.lit(8), F.lit(False)
    for depth, big in levels:  # each entry's bucket is the shortest prefix that fits or is one key
        rows = rows.join(big.select(F.col("prefix").alias(f"p{depth}"), F.col("single").alias(f"s{depth}")), _prefix(depth) == F.col(f"p{depth}"), "left")
        bytes_ = F.when(F.col(f"s{depth}").isNotNull() & ~F.col(f"s{depth}"), F.lit(2 * depth)).otherwise(bytes_)
        single = single | F.coalesce(f"s{depth}", F.lit(False))
    rows = rows.select("key", "ids", F.xxhash64(F.substring("key", F.lit(1), bytes_)).alias("bucket"), single.alias("single"))
    total = table.agg(F.sum(F.size("ids"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 2 * total // bucket_limit)
    found = rows.where("not single").select("bucket", "key", "ids").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, schema)
    if levels:
        own = rows.where("single").select("key", "ids")
        least = own.groupBy("key").agg(F.min(F.array_min("ids")).alias("keeper"), F.sum(F.size("ids")).alias("copies")).where("copies > 1")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keeper, ids, n in zip(common.column(batch, "keeper"), common.column(batch, "ids"), common.column(batch, "copies")):
                    yield batch_of(list(emit(keeper, ids, keeper in ids, n)))

        found = found.unionByName(own.join(least, "key").mapInArrow(write, schema))
    return found


def members(df: DataFrame, id_col: str = "internal_id", text: str = "text", bucket_limit: int = 50_000) -> DataFrame:
    """(keeper_id, internal_id): each member of a group but the smallest id."""
    table = common.cut(entries(df, id_col, text), "copies")
    return _grouped(table, bucket_limit, "keeper_id long, internal_id long", lambda keeper, ids, first, n=0: [(keeper, i) for i in ids if i != keeper])


def copies(df: DataFrame, id_col: str = "internal_id", text: str = "text", bucket_limit: int = 50_000) -> DataFrame:
    """(keeper_id, copies): one row for each group of two or more."""
    table = common.cut(entries(df, id_col, text), "copies")
    return _grouped(table, bucket_limit, "keeper_id long, copies long", lambda keeper, ids, first, n=0: [(keeper, n or len(ids))] if first else [])
