"""Problem 1: a language for each text and each segment of a mixed one.

Words have n-gram likelihoods in each language (word counts smoothed by
letter trigrams).  A text is a mixture: expectation-maximisation over its
words estimates the proportions of a set of languages, and a language joins
the set when the likelihood that it adds exceeds ``PENALTY`` and a clause of
``CLAUSE`` words or more is its own.  Segments are the best path through the
words under the chosen set with a price on each change.  The models are fitted
on a bounded sample of labelled rows (``training_rows``), the labels being
cleaned by the fitted models once; every text is then read whole.

Garbled texts are restored first, look-alike letters folded.  Null, empty and
blank texts, and texts without a word of one of the scripts, have no language
(null, confidence 0).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .lookalike import PLAIN, by_table
from .mojibake import Channel, tables

LANGUAGES = ("bn", "as", "hi", "ne", "en", "bn-Latn")
SCRIPT = {"bn": 0, "as": 0, "hi": 1, "ne": 1, "en": 2, "bn-Latn": 2}
# How labels spell the languages, in lower case, before any region.
SPELLINGS = {
    "bn": "bn", "ben": "bn", "bangla": "bn", "bengali": "bn", "as": "as", "asm": "as", "assamese": "as", "asamiya": "as",
    "hi": "hi", "hin": "hi", "hindi": "hi", "ne": "ne", "nep": "ne", "npi": "ne", "nepali": "ne", "en": "en", "eng": "en",
    "english": "en", "banglish": "bn-Latn", "benglish": "bn-Latn",
}
CLIP = 4.0  # what one word can say at most
CHANGE = 6.0  # the price of a change of language
PENALTY = 10.0  # what a further language must add
CLAUSE = 5  # words
_WORDS = re.compile(r"[ঀ-ৣৰ-৿]+|[ऀ-ॣॱ-ॿ]+|[A-Za-zÀ-ɏ]+(?:['’][A-Za-z]+)?")
_NOT_TEXT = re.compile(r"https?://\S+|www\.\S+|\S*@\S+|#\S+|</?[a-zA-Z]+>|&[a-z]+;")
_ODD = re.compile(f"[^{PLAIN}]")


def label_language(label: str | None) -> str | None:
    """The language a label names by one of the six codes, "other" for another
    language's tag, None where it names none."""
    parts = re.split(r"[-_\s.()]+", (label or "").strip().lower())
    base = SPELLINGS.get(parts[0])
    if base is None:
        return None
    if "latn" in parts[1:] or "latin" in parts[1:] or "roman" in parts[1:]:
        return "bn-Latn" if base in ("bn", "bn-Latn") else "other"
    return base


def label_column(label: Column) -> Column:
    """``label_language`` as an expression."""
    parts = F.split(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[-_\s.()]+")
    base = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])[parts[0]]
    latin = F.arrays_overlap(F.slice(parts, 2, 9), F.array(*map(F.lit, ("latn", "latin", "roman"))))
    return F.when(base.isNotNull() & latin, F.when(base.isin("bn", "bn-Latn"), F.lit("bn-Latn")).otherwise(F.lit("other"))).otherwise(base)


def words_of(text: str) -> list[str]:
    """The words of a text, lower case, with look-alikes folded; no addresses, handles, hashtags or markup."""
    if _ODD.search(text):
        text = by_table(text)
    if "/" in text or "@" in text or "#" in text or "&" in text or "www." in text:
        text = _NOT_TEXT.sub(" ", text)
    return _WORDS.findall(text.lower())


class Models:
    """Likelihoods of words by language."""

    WEIGHT = 30.0  # of the letter model against a count

    def __init__(self, counts: dict[str, Counter], texts: Counter | None = None):
        self.words = [counts.get(k, Counter()) for k in LANGUAGES]
        self.totals = [sum(c.values()) for c in self.words]
        # without a word to read, the mixture's likelihood is the same everywhere: the most written language of a script that isn't Latin
        self.unread = max((k for k, name in enumerate(LANGUAGES) if SCRIPT[name] != 2), key=lambda k: (texts or {}).get(LANGUAGES[k], 0))
        self.three, self.two, self.one = [], [], []
        for c in self.words:
            three, two, one = Counter(), Counter(), Counter()
            for word, n in c.items():
                n = 1 + math.log(n)
                padded = "^^" + word + "$"
                for i in range(2, len(padded)):
                    three[padded[i - 2 : i + 1]] += n
                    two[padded[i - 2 : i]] += n
                    one[padded[i]] += n
            self.three.append(three), self.two.append(two), self.one.append((one, sum(one.values()) + 200))
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES)))

    def letters(self, word: str, k: int) -> float:
        three, two, (one, total), out = self.three[k], self.two[k], self.one[k], 0.0
        padded = "^^" + word + "$"
        for i in range(2, len(padded)):
            n = two.get(padded[i - 2 : i], 0)
            p = (one.get(padded[i], 0) + 1) / total
            out += math.log((three.get(padded[i - 2 : i + 1], 0) + 4 * p) / (n + 4))
        return out

    def word(self, word: str) -> np.ndarray:
        """Log-likelihoods less the greatest, within CLIP."""
        script = 0 if "ঀ" <= word[0] <= "৿" else 1 if "ऀ" <= word[0] <= "ॿ" else 2
        found = np.full(len(LANGUAGES), -math.inf)
        for k, name in enumerate(LANGUAGES):
            if SCRIPT[name] == script:
                q = math.exp(max(self.letters(word, k), -60.0))
                found[k] = math.log((self.words[k].get(word, 0) + self.WEIGHT * q + 1e-9) / (self.totals[k] + self.WEIGHT))
        return np.maximum(found - found.max(), -CLIP)

    def rows(self, words: list[str]) -> np.ndarray:
        """The table's rows of words; words not seen before are added."""
        memo, out = self.memo, []
        for w in words:
            k = memo.get(w)
            if k is None:
                if len(memo) == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                memo[w] = k = len(memo)
                self.table[k] = self.word(w)
            out.append(k)
        return np.array(out, np.int64)

    def scores(self, words: list[str]) -> np.ndarray:
        rows = self.rows(words)
        return self.table[rows]

    def read_all(self, texts: list[list[str]]) -> list[tuple[list, list, np.ndarray] | None]:
        """``read`` of each text of a batch; those that no mixture can better go
        by their sums at once.  None for a text without words."""
        if len(self.memo) > 300_000:
            self.memo.clear()
        out: list = [None] * len(texts)
        have = [k for k, words in enumerate(texts) if words]
        if not have:
            return out
        rows = [self.rows(texts[k]) for k in have]
        starts = np.cumsum([0, *map(len, rows)])
        scores = self.table[np.concatenate(rows)]
        sums = np.add.reduceat(scores, starts[:-1])
        best, top = sums.argmax(1), sums.max(1)
        margins = np.exp(np.clip((sums - top[:, None]) / 2, -30, 0)).sum(1)
        for n, k in enumerate(have):
            own = scores[starts[n] : starts[n + 1]]
            if -top[n] < PENALTY:
                out[k] = ([(int(best[n]), 1 / margins[n])], [(int(best[n]), 0, len(own))], own)
            else:
                out[k] = (*self.read(own), own)
        return out

    def mixture(self, scores: np.ndarray, chosen: list[int], rounds: int = 12) -> tuple[float, np.ndarray]:
        """The likelihood of a text under a set of languages, and their proportions, by EM."""
        p = np.exp(scores[:, chosen])
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(rounds):
            r = p * share
            share = (r / r.sum(1, keepdims=True)).mean(0)
        return float(np.log(p @ share).sum()), share

    def path(self, scores: np.ndarray, chosen: list[int]) -> list[int]:
        """The best sequence of languages, each change at a price."""
        best = scores[0, chosen].tolist()
        back = []
        for row in scores[1:, chosen].tolist():
            top = max(range(len(best)), key=best.__getitem__)
            came = [k if best[k] >= best[top] - CHANGE else top for k in range(len(best))]
            best = [max(best[k], best[top] - CHANGE) + row[k] for k in range(len(best))]
            back.append(came)
        state = max(range(len(best)), key=best.__getitem__)
        out = [state]
        for came in reversed(back):
            state = came[state]
            out.append(state)
        return [chosen[k] for k in reversed(out)]

    @staticmethod
    def runs(path: list[int]) -> list[tuple[int, int, int]]:
        """(language, start, end) of the stretches of a path."""
        edges = [0] + [k for k in range(1, len(path)) if path[k] != path[k - 1]] + [len(path)]
        return [(path[a], a, b) for a, b in zip(edges, edges[1:])]

    def read(self, scores: np.ndarray) -> tuple[list[tuple[int, float]], list[tuple[int, int, int]]]:
        """Of a text's word scores: the languages with their confidence, most
        first, and the segments."""
        sums = scores.sum(0)
        first = int(sums.argmax())
        chosen, like = [first], float(sums[first])
        if -like >= PENALTY:  # the most that any mixture can add
            open_ = [k for k in range(len(LANGUAGES)) if k != first and (scores[:, k] > -0.5).sum() >= CLAUSE]
            while open_:
                tried = [(self.mixture(scores, [*chosen, k])[0], k) for k in open_]
                new, k = max(tried)
                if new - like < PENALTY:
                    break
                chosen.append(k)
                open_.remove(k)
                like = new
            if len(chosen) > 1:
                path = self.path(scores, sorted(chosen))
                longest: dict[int, int] = {}
                for k, a, b in self.runs(path):
                    own = scores[a:b]
                    says = int((own[:, k] - np.delete(own, k, 1).max(1) > 0.7).sum())
                    longest[k] = max(longest.get(k, 0), says if b - a >= CLAUSE else 0)
                kept = [k for k in chosen if longest.get(k, 0) >= CLAUSE - 2]
                chosen = kept or [first]
        if len(chosen) == 1:
            k = chosen[0]
            return [(k, float(1 / np.exp(np.clip((sums - sums[k]) / 2, -30, 30)).sum()))], [(k, 0, len(scores))]
        chosen.sort()
        share = self.mixture(scores, chosen)[1]
        segments = self.runs(self.path(scores, chosen))
        return sorted(((k, float(s)) for k, s in zip(chosen, share)), key=lambda x: -x[1]), segments


def fit(rows: list[tuple[str, str]]) -> Models:
    """Models from (language, text); labels that the first models reject are left out of the second."""
    counts: dict[str, Counter] = {k: Counter() for k in LANGUAGES}
    texts = [(k, words_of(t)) for k, t in rows]
    for k, words in texts:
        counts[k].update(words)
    # letters of a script that a language isn't written in come from wrong labels
    own = {0: "ঀ-৿", 1: "ऀ-ॿ", 2: "A-Za-zÀ-ɏ"}
    for k in LANGUAGES:
        fits = re.compile(f"[{own[SCRIPT[k]]}'’]+").fullmatch
        counts[k] = Counter({w: n for w, n in counts[k].items() if fits(w)})
    models = Models(counts)
    clean: dict[str, Counter] = {k: Counter() for k in LANGUAGES}
    written: Counter = Counter()
    for _, words in texts:
        if words:
            scores = models.scores(words)
            for k, a, b in models.read(scores)[1]:
                written[LANGUAGES[k]] += 1
                clean[LANGUAGES[k]].update(w for w, s in zip(words[a:b], scores[a:b]) if s[k] > -CLIP)
    return Models(clean, written)


def fitted(df: DataFrame, id_col: str, text: str, label: str, training_rows: int) -> Models:
    """Models of about ``training_rows`` labelled rows (all where there are
    fewer), chosen by hash: the rows are counted, then those below the share of
    the hash range that holds so many are fetched, which bounds what is sent."""
    rows = df.select(label_column(F.col(label)).alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(id_col)).alias("h")).where(F.col("k").isin(*LANGUAGES))
    total = rows.count()
    share = min(1.0, training_rows / max(total, 1))
    below = int(share * (1 << 62)) * 4 - (1 << 63)
    if share < 1:
        rows = rows.where(F.col("h") < below)
    rows = rows.where(F.col("t").isNotNull() & ~F.col("t").rlike("[\u0080-ÿ�]|\\?\\?\\?\\?"))
    return fit([(r.k, r.t) for r in rows.collect()])


def languages(df: DataFrame, id_col: str = "internal_id", text: str = "text", label: str = "lang", training_rows: int = 20_000) -> DataFrame:
    """(id_col, label, named, languages, segments, readable): for each row its
    label, what the label names, an array of (lang, confidence), most first, and
    of (lang, words) in order; ``readable`` is whether a word could be read."""
    common.ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    models = sc.broadcast(fitted(df, id_col, text, label, training_rows))
    read_under = sc.broadcast(tables(df, text))
    key = common.fresh_key()
    langs = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64())]))
    segs = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64())]))
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("named", pa.string()), ("words", pa.int32()), ("marks", pa.bool_()), ("languages", langs), ("segments", segs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, channel = common.kept(key, lambda: (models.value, Channel(*read_under.value)))
        named: dict[str | None, str | None] = {}
        for batch in batches:
            texts = [(None, False) if t is None else channel.restore(t) for t in common.column(batch, "text")]
            words = [[] if t is None else words_of(t) for t, _ in texts]
            labels = common.column(batch, "label")
            for x in labels:
                if x not in named:
                    named[x] = label_language(x)
            shown, parts = [], []
            for found, (_, marked), x in zip(model.read_all(words), texts, labels):
                if found is None:
                    # Of a garbled text without a readable word only the script is known: it isn't Latin, so a Latin label is wrong.
                    guess = marked and named[x] in (None, "en", "bn-Latn", "other")
                    lang = LANGUAGES[model.unread]
                    shown.append([{"lang": lang, "confidence": 0.0}] if guess else [])
                    parts.append([{"lang": lang, "words": 0, "confidence": 0.0}] if guess else [])
                    continue
                sure, segments, scores = found
                shown.append([{"lang": LANGUAGES[k], "confidence": c} for k, c in sure])
                if len(segments) == 1:
                    parts.append([{"lang": LANGUAGES[segments[0][0]], "words": segments[0][2], "confidence": sure[0][1]}])
                    continue
                parts.append([])
                for k, a, b in segments:
                    sums = scores[a:b].sum(0)
                    parts[-1].append({"lang": LANGUAGES[k], "words": b - a, "confidence": float(1 / np.exp(np.clip(sums - sums[k], -30, 30)).sum())})
            lengths = [0 if t is None else len(t.split(None, 4)) for t, _ in texts]
            out = [batch.column(batch.schema.get_field_index("id")), labels, [named[x] for x in labels], lengths, [m for _, m in texts], shown, parts]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = common.rows_of(df, id=F.col(id_col).cast("long"), text=F.col(text), label=F.col(label).cast("string"))
    ddl = "id long, label string, named string, words int, marks boolean, languages array<struct<lang: string, confidence: double>>, segments array<struct<lang: string, words: int, confidence: double>>"
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def mislabelled(df: DataFrame, id_col: str = "internal_id", text: str = "text", label: str = "lang", **kw) -> DataFrame:
    """(id_col, lang): of texts of four words or more, those whose label names no
    language or another, and every language of mixed ones."""
    rows = languages(df, id_col, text, label, **kw).where("words >= 4")
    mixed = F.size("languages") > 1
    own = F.when(F.size("languages") > 0, F.col("languages.lang"))
    wrong = F.col("named").isNull() | (F.col("named") != own[0])
    return rows.where(own.isNotNull() & (mixed | wrong)).select(id_col, F.explode(own).alias("lang"))
