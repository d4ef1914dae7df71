"""Problem 3: one consistent form for texts that look the same.

A word that is not in plain form is looked up in a trie of the corpus's plain
words by an edit automaton in which look-alike letters, canonically equivalent
sequences and ignorable characters cost nothing and every other edit costs
one.  Of the words found at cost nought the one with the fewest second choices
is canonical (Ukrainian capital I is an "I" before it is an "l"), of these the
most frequent.  Words the trie doesn't hold are normalised by the table, which
takes the first choice.

The look-alikes are those of a short list and of Unicode's own table of
confusable characters, which Spark's ICU library holds (``confusables``).

All plain words that recur are the vocabulary.  It stays in a table: it meets
the texts' odd words by their shape (the form that all spellings of one look
share), each partition builds the trie of its part, and only those spellings
that the table alone wouldn't give are joined back to the texts that ask for
them.  So nothing that grows with the data is sent to the driver or to all.

Null text gives null, empty or blank text the empty string.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "α": "a", "ν": "v", "ι": "i",
    # Latin beyond ASCII
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i",
}
# Sequences that look like one letter.
SEQUENCES = {"অা": "আ", "ত্‍": "ৎ", "ব়": "র", "अा": "आ", "अो": "ओ", "अौ": "औ", "एे": "ऐ"}

PLAIN = r"\t\n\r -~।॥ঀ-৛৞ৠ-৿ँ-नप-रलळव-ॗॠ-९\U0001f300-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff"
_ODD = re.compile(rf"[^{PLAIN}]|অা|ে[াৗ]|়্|ব়|[नरळ]़|अ[ाोौ]|एे")
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")
_WORD = re.compile(r"[^\s!-/:-@\[-`{-~।॥]+")
_TABLE = {ord(k): v for k, v in LOOKALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_TABLE |= {c: " " for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]}
_FOLD = re.compile("|".join(SEQUENCES))
# ZWJ stays inside emoji and before a virama, ZWNJ after one: there they are seen.
_IGNORABLE = re.compile(
    "[­͏؜᠎​‎‏‪-‮⁠-⁤⁦-⁯﻿]"
    "|(?<![্्])‌|(?<![☀-➿️\U0001f000-\U0001ffff])‍(?![্्])"
)


def is_ignorable(text: str, at: int) -> bool:
    m = _IGNORABLE.match(text, at)
    return m is not None


def by_table(text: str, table: dict[int, str] = _TABLE) -> str:
    """The form of a text or word by a table alone."""
    text = unicodedata.normalize("NFC", text.translate(table))
    text = _FOLD.sub(lambda m: SEQUENCES[m[0]], text)
    return unicodedata.normalize("NFC", _IGNORABLE.sub("", text))


#: Scripts of which letters are taken for Latin ones, by the first word of their Unicode names.
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "MATHEMATICAL", "FULLWIDTH", "SCRIPT", "BLACK-LETTER", "DOUBLE-STRUCK", "PLANCK", "ROMAN", "SMALL")


@lru_cache(1)
def confusables(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    """The Latin letters (or ligatures' letters) that other letters look like,
    the first choice, which is of the same case, first: by ICU's table of
    confusable characters.  Its size is bounded by Unicode's."""
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()

    def skeletons(parts: list[str]) -> list[str]:
        return checker.getSkeleton("\n".join(parts)).split("\n")

    latin = [*map(chr, range(65, 91)), *map(chr, range(97, 123))]
    looks: dict[str, list[str]] = {}
    for c, look in zip(latin, skeletons(latin)):
        looks.setdefault(look, []).append(c)
    others = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Nl") and unicodedata.name(c).split()[0] in SCRIPTS]
    parts = [n if (n := unicodedata.normalize("NFKC", c)).isascii() and n.isalpha() else c for c in others]
    out = {}
    for c, part, look, own in zip(others, parts, skeletons(others), skeletons(parts)):
        if look in looks:
            upper = unicodedata.category(c) in ("Lu", "Lt")
            out[c] = tuple(sorted(looks[look], key=lambda x: (x.isupper() != upper, x)))
        elif part.isascii() and look == own:
            out[c] = (part,)
    return out


class Automaton:
    """A trie of plain words (with their counts), walked with edits:
    look-alikes, equivalent sequences and ignorables at no cost, any other edit
    at cost one.  ``alternatives`` are letters with what they look like, the
    first choice first."""

    END = ""

    def __init__(self, words: Iterable[str] | dict[str, int], alternatives: dict[str, tuple[str, ...]] | None = None):
        self.root: dict = {}
        self.alternatives = alternatives or {}
        self.counts = words if isinstance(words, dict) else {}
        for word in words:
            self.add(word)

    def add(self, word: str, count: int = 0) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[self.END] = word
        if count:
            self.counts[word] = count

    def _steps(self, text: str, at: int) -> Iterator[tuple[str, int, int]]:
        """What the input at a place may stand for at no cost: characters, next place, whether it is a second choice."""
        c = text[at]
        if is_ignorable(text, at):
            yield "", at + 1, 0
        for n in (3, 2):
            if (part := text[at : at + n]) in SEQUENCES:
                yield SEQUENCES[part], at + n, 0
            elif len(part) == n and (whole := unicodedata.normalize("NFC", part)) != part:
                yield whole, at + n, 0
        other = _TABLE.get(ord(c))
        first = unicodedata.normalize("NFC", c) if other is None else other
        choices = self.alternatives.get(c, ())
        yield (choices[0] if choices and other is None else first), at + 1, 0
        for x in choices:
            if x != first:
                yield x, at + 1, int(other is not None or x != choices[0])

    def match(self, text: str, most: int = 0) -> str | None:
        """The cheapest word within cost ``most``; of several the one with the
        fewest second choices, then the most frequent, then the first by spelling."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        todo: list[tuple[int, int, int, dict]] = [(0, 0, 0, self.root)]
        found: list[tuple[int, int, int, str]] = []
        while todo:
            cost, second, at, node = todo.pop()
            if best.get((at, id(node)), (most + 1, 0)) <= (cost, second):
                continue
            best[at, id(node)] = cost, second
            if at == len(text):
                if self.END in node:
                    word = node[self.END]
                    found.append((cost, second, -self.counts.get(word, 0), word))
            else:
                for part, after, other in self._steps(text, at):
                    there: dict | None = node
                    for c in part:
                        there = there.get(c) if there is not None else None
                    if there is not None:
                        todo.append((cost, second + other, after, there))
            if cost < most:
                if at < len(text):
                    todo.append((cost + 1, second, at + 1, node))
                for c, there in node.items():
                    if c != self.END:
                        todo.append((cost + 1, second, at, there))
                        if at < len(text):
                            todo.append((cost + 1, second, at + 1, there))
        return min(found)[3] if found else None


class Canonicaliser:
    """Canonical forms of texts, with a memo of words already seen: under a
    vocabulary, or under the spellings that were found for a text's words."""

    MEMO = 200_000

    def __init__(self, vocabulary: Iterable[str] | dict[str, int] = (), alternatives: dict[str, tuple[str, ...]] | None = None):
        self.automaton = Automaton(vocabulary, alternatives) if vocabulary else None
        self.table = {ord(k): v[0] for k, v in (alternatives or {}).items()} | _TABLE
        self.memo: dict[str, str] = {}

    def by_table(self, text: str) -> str:
        return by_table(text, self.table)

    def word(self, word: str) -> str:
        if not _ODD.search(word):
            return word
        found = self.memo.get(word)
        if found is None:
            found = self.automaton.match(word) if self.automaton else None
            if found is None:
                found = self.by_table(word)
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def text(self, text: str, forms: Iterable[tuple[str, str]] | None = None) -> str:
        """The canonical form, runs of blanks as one space, none at the ends;
        ``forms`` are spellings found for words of the text."""
        if _ODD.search(text):
            own = dict(forms or ())
            # Odd characters that aren't inside a word (spaces, marks) go by the table.
            text = self.by_table(_WORD.sub(lambda m: own.get(m[0]) or self.word(m[0]), text))
        return _BLANKS.sub(" ", text).strip(" ")


def blanks(text: str) -> str:
    return _BLANKS.sub(" ", text).strip(" \t\n\r\f\v")


def is_case(text: str | None, least_words: int = 4) -> bool:
    """Not null, four words or more, and a letter or digit."""
    return text is not None and len(text.split(None, least_words)) >= least_words and any(c.isalnum() for c in text)


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """(w, count): all plain words of two letters or more that occur twice or more, over all rows."""
    words = F.split(F.col(text), r"[\s!-/:-@\[-`{-~।॥]+")
    plain = rf"^[{PLAIN}]+$".replace(r"\U0001f300-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff", "")
    found = df.select(F.explode(words).alias("w")).groupBy("w").count().where("count > 1 and length(w) > 1")
    return found.where(F.col("w").rlike(plain) & ~F.col("w").rlike("অা|ে[াৗ]|়্|ব়|[नरळ]़|अ[ाोौ]|एे"))


#: The characters of texts that may change, for Spark's own filter.
ODD = "[^" + PLAIN.replace(r"\U0001f300-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff", r"\x{1f300}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f900}-\x{1f9ff}") + "]|" + _ODD.pattern.split("]|", 1)[1]


def _odd_words(df: DataFrame, text: str, alternatives: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, word, shape): the words not in plain form, by the hash of their text."""
    known = df.sparkSession.sparkContext.broadcast(alternatives)
    kept = common.fresh_key()
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("shape", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = common.kept(kept, lambda: Canonicaliser((), known.value))
        fold = _folds(known.value)
        for batch in batches:
            out: dict[tuple[int, str], str] = {}
            for k, t in zip(common.column(batch, "key"), common.column(batch, "text")):
                for w in _WORD.findall(t):
                    if _ODD.search(w):
                        out[k, w] = to.word(w).translate(fold)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([w for _, w in out], pa.string()), pa.array(list(out.values()), pa.string())], schema=schema)

    rows = common.rows_of(df.where(F.col(text).rlike(ODD)), key=F.xxhash64(text), text=F.col(text))
    return rows.mapInArrow(run, "key long, word string, shape string")


def _folds(alternatives: dict[str, tuple[str, ...]]) -> dict[int, str]:
    """Letters that one look-alike may stand for, all as the same one."""
    return {ord(x): min(c) for c in alternatives.values() if len(c) > 1 for x in c}


def spellings(df: DataFrame, text: str = "text") -> DataFrame | None:
    """(key, forms): for the texts (by ``xxhash64``) with words whose canonical
    spelling by the vocabulary isn't the table's, these words and spellings;
    None where there are none."""
    spark = df.sparkSession
    common.ship(spark)
    alternatives = confusables(spark)
    fold = _folds(alternatives)
    odd = _odd_words(df, text, alternatives)
    asked = common.cut(odd.groupBy("word", "shape").agg(F.lit(0).alias("n")), "odd")
    shape = F.translate("w", "".join(map(chr, fold)), "".join(fold.values())) if fold else F.col("w")
    words = counted(df, text).select(F.col("w").alias("word"), shape.alias("shape"), F.col("count").alias("n")).join(asked.select("shape").distinct(), "shape", "left_semi")
    known = spark.sparkContext.broadcast(alternatives)
    schema = pa.schema([("word", pa.string()), ("form", pa.string())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, to = Automaton({}, known.value), Canonicaliser((), known.value)
        for batch in batches:
            out = []
            for word, n in zip(common.column(batch, "word"), common.column(batch, "n")):
                if n:  # the vocabulary comes first
                    trie.add(word, n)
                elif (form := trie.match(word)) is not None and form != to.word(word):
                    out.append((word, form))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    both = words.select("word", "shape", "n").unionByName(asked.select("word", "shape", F.col("n").cast("long").alias("n")))
    forms = common.cut(both.repartition("shape").sortWithinPartitions(F.desc("n")).select("word", "n").mapInArrow(search, "word string, form string"), "forms")
    if forms.isEmpty():
        return None
    return odd.select("key", "word").join(forms, "word").groupBy("key").agg(F.collect_set(F.struct("word", "form")).alias("forms"))


def with_forms(rows: DataFrame, found: DataFrame | None, text: Column) -> DataFrame:
    """``rows`` with ``forms``, the spellings found for the words of each text."""
    if found is None:
        return rows.withColumn("forms", F.lit(None).cast("array<struct<word: string, form: string>>"))
    return rows.withColumn("_key", F.xxhash64(text)).join(found.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def pairs_of(forms: list | None) -> list[tuple[str, str]]:
    return [(f["word"], f["form"]) for f in forms or ()]


def canonical_text(df: DataFrame, text: str = "text", out: str = "canonical_text") -> DataFrame:
    """Adds ``out``, the canonical form of ``text``.  A column of the name ``out``
    that ``df`` already has is replaced."""
    common.ship(df.sparkSession)
    rows = with_forms(df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text")), spellings(df, text), F.col("text"))
    known = df.sparkSession.sparkContext.broadcast(confusables(df.sparkSession))
    key = common.fresh_key()

    @F.pandas_udf("string")
    def form(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        to = common.kept(key, lambda: Canonicaliser((), known.value))
        for texts, forms in batches:
            yield pd.Series([None if t is None else to.text(t, pairs_of(f)) for t, f in zip(texts, forms)], dtype=object)

    rows = rows.select("row", form("text", "forms").alias("form"))
    return rows.select(*(F.col("row")[c].alias(c) for c in df.columns if c != out), F.col("form").alias(out))


def keys(df: DataFrame, id_col: str = "internal_id", text: str = "text") -> DataFrame:
    """(id, look, code): 128-bit hashes of the canonical form and of the text as
    it stands but for runs of blanks; one row for each text that can be a case."""
    common.ship(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(confusables(df.sparkSession))
    key = common.fresh_key()
    schema = pa.schema([("id", pa.int64()), ("look", pa.binary()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, digest = common.kept(key, lambda: Canonicaliser((), known.value)), xxhash.xxh3_128_digest
        for batch in batches:
            ids, looks, codes = [], [], []
            for i, t, forms in zip(common.column(batch, "id"), common.column(batch, "text"), common.column(batch, "forms")):
                if i is not None and is_case(t):
                    ids.append(i)
                    codes.append(digest(blanks(t).encode("utf-8", "surrogatepass")))
                    looks.append(digest(to.text(t, pairs_of(forms)).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(codes, pa.binary())], schema=schema)

    rows = common.rows_of(df, id=F.col(id_col).cast("long"), text=F.col(text)).where("text is not null")
    return with_forms(rows, spellings(df, text), F.col("text")).mapInArrow(run, "id long, look binary, code binary")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of classes of two or more spellings, found by a map-side combined aggregate."""
    mixed = rows.groupBy("look").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).where("lo <> hi").select("look")
    return rows.join(mixed, "look", "left_semi")


def lookalike_pairs(df: DataFrame, id_col: str = "internal_id", text: str = "text") -> DataFrame:
    """(internal_id_a, internal_id_b): rows that look the same with different code
    points.  The hashes are written once; only classes of two or more spellings
    reach the join, whose hot classes adaptive execution splits."""
    rows = _mixed(common.cut(keys(df, id_col, text), "look"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, F.expr("a.look = b.look and a.code <> b.code and a.id < b.id"))
    return pairs.select(F.col("a.id").alias("internal_id_a"), F.col("b.id").alias("internal_id_b"))


def lookalike_members(df: DataFrame, id_col: str = "internal_id", text: str = "text") -> DataFrame:
    """(internal_id, class_id, spelling_id): the rows of classes of two or more
    spellings with the smallest id of their class and of their spelling: all
    that the pairs say, one row a row."""
    rows = _mixed(common.cut(keys(df, id_col, text), "look"))
    least = rows.groupBy("look", "code").agg(F.min("id").alias("spelling_id"))
    first = least.groupBy("look").agg(F.min("spelling_id").alias("class_id"))
    return rows.join(least, ["look", "code"]).join(first, "look").select(F.col("id").alias("internal_id"), "class_id", "spelling_id")
