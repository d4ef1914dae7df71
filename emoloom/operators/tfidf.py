"""TF-IDF of words and of letters within words.

All terms of a document are in its row, so a row is weighed where it stands:
the vocabulary, bounded by ``max_features`` of each block, is broadcast, and
one Arrow pass counts a row's terms, weighs and normalises them.  No term is
shuffled.  Fitting shuffles words (for the letters, whose n-grams lie within
words and are made once for each distinct word) or word n-grams, combined
first, to find the most frequent; a second pass within the rows counts their
documents.  Word and letter blocks are weighed and normalised apart, then put
side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import col

from ..functions.text import tokens

WORD = {"ngram_range": (1, 2), "max_features": 10_000}
CHAR = {"ngram_range": (3, 5), "max_features": 15_000}
LARGEST = 1_000_000  # terms of a vocabulary, which is broadcast


def word_ngrams(tok: Column, lo: int = 1, hi: int = 2) -> Column:
    """The words (a column of its own, see ``tokens_of``) and runs of them, joined by one space."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(tok) >= n, F.sequence(F.lit(1), F.size(tok) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return tok if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice(tok, i, F.lit(n)), " "))

    return F.concat(*(runs(n) for n in range(lo, hi + 1)))


def char_ngrams(word: Column, lo: int = 3, hi: int = 5) -> Column:
    """Letter n-grams of a word with a space on both sides; a word as long as n
    or shorter gives itself once and no longer n-grams."""
    w, length = F.concat(F.lit(" "), word, F.lit(" ")), F.length(word) + 2

    def windows(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))

    def up_to(n: int) -> Column:
        # a word as long as n stands for itself, which its only window is too
        parts = [windows(k) for k in range(lo, n + 1)]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    out = up_to(hi)
    for n in range(hi - 1, lo - 1, -1):
        out = F.when(length <= n, up_to(n)).otherwise(out)
    return F.when(length < lo, F.array(w)).otherwise(out)


def tokens_of(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, tok): the lower-case words of a text."""
    return df.select(col(doc).alias("doc"), tokens(F.lower(col(text))).alias("tok"))


def term_counts(tok: DataFrame, kind: str, lo: int, hi: int) -> DataFrame:
    """(term, tf) of the corpus, combined before the shuffle."""
    if kind == "word":
        return tok.select(F.explode(word_ngrams(col("tok"), lo, hi)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    words = tok.select(F.explode("tok").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("n", F.explode(char_ngrams(col("word"), lo, hi)).alias("term")).groupBy("term").agg(F.sum("n").alias("tf"))


def in_rows(tok: DataFrame, blocks: list[Block], n_docs: int | None) -> DataFrame:
    """One Arrow pass over (doc, tok).  With ``n_docs``: (doc, block, indices,
    values), the weights of each row, a row for each block; without: (block,
    idx, df), how many rows of each partition have each term."""
    import pyarrow as pa

    counting = n_docs is None
    plan = tok.sparkSession.sparkContext.broadcast([(b.kind, b.lo, b.hi, b.terms, b.df) for b in blocks])
    doc = tok.schema["doc"].dataType

    def run(batches):
        import math

        import numpy as np

        def words(ids, lo, hi):
            def of(tok):
                found = [ids.get(w) for w in tok] if lo == 1 else []
                for n in range(max(lo, 2), hi + 1):
                    found += [ids.get(" ".join(tok[k : k + n])) for k in range(len(tok) - n + 1)]
                return [k for k in found if k is not None]

            return of

        def letters(ids, lo, hi):
            memo: dict[str, list[int]] = {}

            def one(word):
                w, found = f" {word} ", []
                for n in range(lo, hi + 1):
                    if len(w) <= n:
                        found.append(ids.get(w))
                        break
                    found += [ids.get(w[k : k + n]) for k in range(len(w) - n + 1)]
                return [k for k in found if k is not None]

            def of(tok):
                out = []
                for w in tok:
                    got = memo.get(w)
                    if got is None:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[w] = got = one(w)
                    out += got
                return out

            return of

        own = []
        for kind, lo, hi, terms, df in plan.value:
            ids = {t: k for k, t in enumerate(terms)}
            idf = None if counting else np.array([math.log((1 + n_docs) / (1 + n)) + 1 for n in df])
            own.append(((words if kind == "word" else letters)(ids, lo, hi), idf, np.zeros(len(terms), np.int64)))
        for batch in batches:
            docs, blocks_, indices, values = [], [], [], []
            ids_ = batch.column(0) if not counting else None
            for row, tok in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for b, (of, idf, total) in enumerate(own):
                    at, tf = np.unique(np.array(of(tok), np.int32), return_counts=True)
                    if counting:
                        total[at] += 1
                    else:
                        v = (1 + np.log(tf)) * idf[at]
                        docs.append(row)
                        blocks_.append(b)
                        indices.append(at)
                        values.append(v / math.sqrt(float(v @ v)) if len(v) else v)
            if not counting:
                yield pa.RecordBatch.from_arrays([ids_.take(pa.array(docs, pa.int32())), pa.array(blocks_, pa.int32()), pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["doc", "block", "indices", "values"])
        if counting:
            for b, (_, _, total) in enumerate(own):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["block", "idx", "df"])

    if counting:
        return tok.select("tok").mapInArrow(run, "block int, idx int, df long").groupBy("block", "idx").agg(F.sum("df").alias("df"))
    return tok.select("doc", "tok").mapInArrow(run, f"doc {doc.simpleString()}, block int, indices array<int>, values array<double>")


@dataclass
class Block:
    """The vocabulary of words or letters: terms in order of their spelling with their counts."""

    kind: str
    lo: int
    hi: int
    terms: list[str]
    tf: list[int]
    df: list[int]

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, idx, tf, df)."""
        rows = [(t, k, self.tf[k], self.df[k]) for k, t in enumerate(self.terms)]
        return spark.createDataFrame(rows, "term string, idx int, tf long, df long")


def fitted(tok: DataFrame, settings: list[tuple[str, dict]]) -> list[Block]:
    """The vocabularies of (doc, tok): of each block the ``max_features`` most
    frequent terms, of equals the first by spelling, numbered by spelling."""
    blocks = []
    for kind, s in settings:
        if s["max_features"] > LARGEST:
            raise ValueError(f"a vocabulary of more than {LARGEST} terms isn't broadcast")
        (lo, hi), limit = s["ngram_range"], s["max_features"]
        top = term_counts(tok, kind, lo, hi).orderBy(F.desc("tf"), "term").limit(limit)
        rows = sorted((r.term, r.tf) for r in top.collect())
        blocks.append(Block(kind, lo, hi, [t for t, _ in rows], [n for _, n in rows], [0] * len(rows)))
    for r in in_rows(tok, blocks, None).collect():
        blocks[r.block].df[r.idx] = r.df
    return blocks


def vocabulary(df: DataFrame, doc: str, text: str, kind: str, limit: int) -> DataFrame:
    """(term, idx, tf, df): the vocabulary of one block."""
    settings = {**(WORD if kind == "word" else CHAR), "max_features": limit}
    return fitted(tokens_of(df, doc, text).persist(), [(kind, settings)])[0].table(df.sparkSession)


def idf(n: Column | int, df: Column) -> Column:
    """Smooth: ln((1 + n) / (1 + df)) + 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.log((1 + n) / (1 + df)) + 1


def sparsity(values: DataFrame, n_docs: int, width: int) -> DataFrame:
    """One row: the share of empty cells."""
    return values.agg(F.round(1 - F.count("*") / F.lit(float(max(n_docs * width, 1))), 6).alias("sparsity"))


@dataclass
class TfIdf:
    """Word and letter TF-IDF as an estimator: ``fit`` on training texts, then
    ``transform`` any.  ``word`` and ``char`` replace single settings; None
    leaves a block out."""

    word: dict | None = field(default_factory=dict)
    char: dict | None = field(default_factory=dict)
    blocks: list[Block] | None = None
    n_docs: int = 0

    def __post_init__(self) -> None:
        self.word = None if self.word is None else {**WORD, **self.word}
        self.char = None if self.char is None else {**CHAR, **self.char}

    def fit(self, df: DataFrame, doc: str, text: str) -> TfIdf:
        tok = tokens_of(df, doc, text).persist()
        self.blocks = fitted(tok, [(k, s) for k, s in (("word", self.word), ("char", self.char)) if s is not None])
        self.n_docs = tok.count()
        tok.unpersist()
        return self

    def _need(self) -> list[Block]:
        if self.blocks is None:
            raise RuntimeError("fit before transform")
        return self.blocks

    def offsets(self) -> list[int]:
        """Where each block's columns start."""
        out = [0]
        for b in self._need():
            out.append(out[-1] + len(b.terms))
        return out

    def weights(self, df: DataFrame, doc: str, text: str) -> DataFrame:
        """(doc, block, indices, values): each row's weights, of every row of ``df``."""
        return in_rows(tokens_of(df, doc, text), self._need(), self.n_docs)

    def transform(self, df: DataFrame, doc: str, text: str) -> DataFrame:
        """(doc, idx, value): word columns first, then letters."""
        starts = F.array(*map(F.lit, self.offsets()))
        cells = self.weights(df, doc, text).select("doc", starts[col("block")].alias("start"), F.explode(F.arrays_zip("indices", "values")).alias("c"))
        return cells.select("doc", (col("c.indices") + col("start")).alias("idx"), col("c.values").alias("value"))

    def fit_transform(self, df: DataFrame, doc: str, text: str) -> DataFrame:
        return self.fit(df, doc, text).transform(df, doc, text)

    def vectors(self, df: DataFrame, text: str, out: str = "features") -> DataFrame:
        """``df`` with ``out``, each row's sparse vector of MLlib, made in the row."""
        import pyarrow as pa
        from pyspark.ml.linalg import VectorUDT
        from pyspark.sql.types import StructField, StructType

        width, starts = self.offsets()[-1], self.offsets()
        rows = df.select(F.struct(*df.columns).alias("doc"), tokens(F.lower(col(text))).alias("tok"))
        cells = in_rows(rows, self._need(), self.n_docs)
        of = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
        n = len(starts) - 1

        def pack(batches):
            import numpy as np

            for batch in batches:  # the blocks of a row are neighbours
                block, sizes = (x.to_numpy(zero_copy_only=False) for x in (batch.column(1), batch.column(2).value_lengths()))
                at = (batch.column(2).flatten().to_numpy(zero_copy_only=False) + np.repeat(np.array(starts)[block], sizes)).astype(np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)[n - 1 :: n]]).astype(np.int32))
                rows = len(batch) // n
                made = [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, width, np.int32)), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, batch.column(3).flatten())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(range(0, len(batch), n), pa.int32())), pa.StructArray.from_arrays(made, fields=list(of))], names=["doc", "features"])

        schema = StructType([StructField("doc", rows.schema["doc"].dataType), StructField("features", VectorUDT())])
        return cells.mapInArrow(pack, schema).select("doc.*", col("features").alias(out))

    def names(self, spark: SparkSession | None = None) -> DataFrame:
        """(idx, name), prefixed by block."""
        spark = spark or SparkSession.getActiveSession()
        rows = [(start + k, f"{b.kind}_{t}") for b, start in zip(self._need(), self.offsets()) for k, t in enumerate(b.terms)]
        return spark.createDataFrame(rows, "idx int, name string")

    def shape(self) -> tuple[int, int]:
        return self.n_docs, self.offsets()[-1] if self.blocks is not None else self._need()

    def summary(self) -> dict:
        sizes = {f"{b.kind}_features": len(b.terms) for b in self._need()}
        return {"n_docs": self.n_docs, "word_features": 0, "char_features": 0, **sizes, "word": self.word, "char": self.char}

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        spark = spark or SparkSession.getActiveSession()
        rows = [(n, b.kind, b.lo, b.hi, k, t, b.tf[k], b.df[k], self.n_docs) for n, b in enumerate(self._need()) for k, t in enumerate(b.terms)]
        spark.createDataFrame(rows, "block int, kind string, lo int, hi int, idx int, term string, tf long, df long, n long").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **kw) -> TfIdf:
        """A saved estimator; FileNotFoundError where there is none."""
        from pyspark.errors import AnalysisException

        try:
            rows = spark.read.parquet(path).orderBy("block", "idx").collect()
        except AnalysisException as e:
            raise FileNotFoundError(path) from e
        out = cls(**kw)
        out.blocks = []
        for r in rows:
            if r.block == len(out.blocks):
                out.blocks.append(Block(r.kind, r.lo, r.hi, [], [], []))
            b = out.blocks[-1]
            b.terms.append(r.term), b.tf.append(r.tf), b.df.append(r.df)
            out.n_docs = r.n
        return out
