"""Feature groups put together in one vector a row.

A composed extractor is fitted on training rows (vocabularies, scales) and
applied to any; all blocks of a row come from that row, so nothing relies on
the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import MaxAbsScaler, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, functions as F

from ..functions import features as X, text as T
from .tfidf import TfIdf

#: The blocks, in the order of their columns.
BLOCKS = ("tfidf", "emoji", "sentiment", "expressive", "negation")
EXTRA = ("lexicon", "scope", "hashtags", "elongation", "code_mix", "text_stats", "divergence", "verbs", "questions", "contrast", "intensified")
SCALED = ("hashtags", "intensified")

# Which blocks the named experiments use.
EXPERIMENTS = {
    "E0": ("tfidf",), "E1": ("tfidf", "emoji"), "E2": ("tfidf", "sentiment"), "E3": ("tfidf", "expressive"), "E4": ("tfidf", "negation"),
    "E6": ("tfidf", "emoji", "sentiment"), "E7": ("tfidf", "emoji", "sentiment", "expressive"), "E8": ("tfidf", "emoji", "sentiment", "negation"),
    "E9_best": ("tfidf", "emoji", "sentiment", "expressive", "negation"),
    "champion": ("tfidf", "emoji", "lexicon", "scope", "hashtags", "intensified"),
}


def emoji_vocabulary(df: DataFrame, raw: str, least: int = 10, most: int = 100_000) -> list[str]:
    """Emoji that occur in ``least`` training texts or more, by code point; each
    is a column, so more than ``most`` are refused rather than left out."""
    found = df.select(F.explode(F.array_distinct(X.emoji_list(F.col(raw)))).alias("e")).groupBy("e").count()
    rows = found.where(F.col("count") >= least).select("e").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} emoji occur in {least} texts or more: raise least")
    return sorted(r.e for r in rows)


@dataclass
class Extractor:
    """``blocks`` in the order of their columns; raw text feeds the emoji and
    expressive blocks, cleaned text the others."""

    blocks: tuple[str, ...] = ("tfidf",)
    emoji_least: int = 10
    word: dict = field(default_factory=dict)
    char: dict = field(default_factory=dict)
    lexicon_form: str = "raw"
    tfidf: TfIdf | None = None
    emoji: list[str] | None = None
    scalers: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.blocks:
            raise ValueError("no block is enabled")
        if unknown := set(self.blocks) - set(BLOCKS) - set(EXTRA):
            raise ValueError(f"unknown blocks {sorted(unknown)}")

    def _dense(self, block: str, raw: F.Column, clean: F.Column, tok: F.Column, raw_tok: F.Column) -> dict:
        L = X.L
        form = lambda words: L.lexicon(words, self.lexicon_form)
        emotions = {k: form(v) for k, v in L.EMOTIONS.items()}
        negations, intensifiers = form(L.NEGATIONS), form(L.INTENSIFIERS)
        return {
            "emoji": lambda: X.emoji_base(raw) | X.emoji_indicators(raw, self.emoji or []), "sentiment": lambda: X.sentiment(tok, form(L.POSITIVE), form(L.NEGATIVE)),
            "expressive": lambda: X.expressive(raw, raw_tok), "negation": lambda: X.negation_basic(tok, negations, intensifiers, form(L.DIMINISHERS), form(L.VERBS)),
            "lexicon": lambda: X.emotion_lexicon(tok, emotions), "scope": lambda: X.negation_scope(tok, negations, intensifiers, emotions), "hashtags": lambda: X.hashtags(raw),
            "elongation": lambda: X.elongation(raw, raw_tok), "code_mix": lambda: X.code_mix(raw), "text_stats": lambda: X.text_stats(raw, raw_tok),
            "divergence": lambda: X.divergence(raw_tok, tok), "verbs": lambda: X.verb_endings(clean, tok), "questions": lambda: X.questions(raw, raw_tok, form(L.QUESTION_WORDS)),
            "contrast": lambda: X.contrast(tok, form(L.CONNECTIVES), emotions), "intensified": lambda: X.intensified(tok, intensifiers, emotions),
        }[block]()

    def dense_names(self, block: str) -> list[str]:
        c = F.lit("")
        return list(self._dense(block, c, c, T.tokens(c), T.tokens(c)))

    def _blocks(self, df: DataFrame, raw: str, clean: str) -> DataFrame:
        rows = df.withColumns({"_tok": T.tokens(F.col(clean)), "_raw_tok": T.tokens(F.col(raw))})
        for block in self.blocks:
            if block != "tfidf":
                columns = self._dense(block, F.col(raw), F.col(clean), F.col("_tok"), F.col("_raw_tok"))
                rows = rows.withColumn(f"_{block}", F.array(*columns.values()))
        return rows.drop("_tok", "_raw_tok")

    def fit(self, df: DataFrame, doc: str, raw: str, clean: str) -> Extractor:
        if "tfidf" in self.blocks:
            self.tfidf = TfIdf(self.word, self.char).fit(df, doc, clean)
        if "emoji" in self.blocks:
            self.emoji = emoji_vocabulary(df, raw, self.emoji_least)
        for block in self.blocks:
            if block in SCALED:  # scales are the training rows' only
                self.scalers[block] = MaxAbsScaler(inputCol=f"_v_{block}", outputCol=f"_s_{block}").fit(self._vectors(self._blocks(df, raw, clean), [block]))
        self.fitted = True
        return self

    @staticmethod
    def _vectors(df: DataFrame, blocks: list[str]) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return df.withColumns({f"_v_{b}": array_to_vector(f"_{b}") for b in blocks})

    def transform(self, df: DataFrame, doc: str, raw: str, clean: str) -> DataFrame:
        """``df`` with ``features``; RuntimeError before ``fit``."""
        if not getattr(self, "fitted", False):
            raise RuntimeError("fit before transform")
        dense = [b for b in self.blocks if b != "tfidf"]
        rows = self._blocks(df, raw, clean)
        if "tfidf" in self.blocks:  # the terms' vector is made in the row, which goes through as it is
            rows = self.tfidf.vectors(rows, clean, "_v_tfidf")
        rows = self._vectors(rows, dense)
        inputs = []
        for block in self.blocks:
            if block == "tfidf":
                inputs.append("_v_tfidf")
            elif block in self.scalers:
                rows = self.scalers[block].transform(rows)
                inputs.append(f"_s_{block}")
            else:
                inputs.append(f"_v_{block}")
        out = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
        return out.select(*df.columns, "features")

    def width(self) -> int:
        return (self.tfidf.shape()[1] if "tfidf" in self.blocks else 0) + sum(len(self.dense_names(b)) for b in self.blocks if b != "tfidf")

    def names(self) -> list[str]:
        out: list[str] = []
        for block in self.blocks:
            out += [r.name for r in self.tfidf.names().orderBy("idx").collect()] if block == "tfidf" else self.dense_names(block)
        return out


def extractor(name: str, **settings) -> Extractor:
    """A named experiment's extractor; ValueError on an unknown name."""
    if name not in EXPERIMENTS:
        raise ValueError(f"unknown experiment {name!r}; there are {', '.join(EXPERIMENTS)}")
    return Extractor(EXPERIMENTS[name], **settings)


def columns_of(df: DataFrame, places: list[int] | range, out: str = "part") -> DataFrame:
    """Some columns of ``features``: word or letter terms only, a selection."""
    return VectorSlicer(inputCol="features", outputCol=out, indices=list(places)).transform(df)


def max_abs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over its greatest absolute value (1 where that is 0 or missing), one row from an aggregate."""
    tops = df.agg(*(F.max(F.abs(F.col(c))).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c) / float(tops[c] or 1.0) for c in columns})
