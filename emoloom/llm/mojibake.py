"""Problem 4: texts decoded with a wrong encoding, wholly or in part.

A noisy channel: what stands in a text was made from UTF-8 bytes by one of
several single-byte decoders (once or twice), by a legacy font whose glyphs
lie on Latin letters, or by replacing what couldn't be decoded.  The
characters of a damaged span are turned back into a lattice of bytes in which
lost bytes are wildcards, and a Viterbi search over places and letters finds
the best reading of it: under the letter pairs of the corpus's words, and
words with wildcards as the most frequent word that fits.  A span is
changed only where its bytes form sequences that chance doesn't: accents,
styled punctuation and question marks of the author's stay.

The frequencies are those of all recurring words, which stay in a table: the
damaged texts are read first for the words and the patterns of lost letters
they ask for, these are joined to the table, and only what was found is
broadcast, with the letter pairs (as many as the alphabets allow).

Texts of question marks or replacement characters are found, and restored
where a word of the vocabulary, or a letter model for single lost letters,
fits.  Null gives null; an empty or blank text stays as it is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .lookalike import PLAIN, counted

ENCODINGS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")


def _reverse(name: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
        if name == "cp1252":  # what it leaves undefined passes through, as do Latin-1's controls
            out.setdefault(chr(b), b)
    return out


BYTES = {name: _reverse(name) for name in ENCODINGS}
_HIGH = {name: "".join(map(re.escape, table)) for name, table in BYTES.items()}
#: A lead byte and what may follow it, as the decoder shows them.  �, ? and a space may stand for a lost byte.
_LEADS = {name: "".join(re.escape(c) for c, b in table.items() if 0xC2 <= b <= 0xF4) for name, table in BYTES.items()}
_CONT = {name: "".join(re.escape(c) for c, b in table.items() if b < 0xC0) for name, table in BYTES.items()}
_SPANS = {name: re.compile(f"(?:[{_LEADS[name]}][{_CONT[name]}]{{1,3}}|[{_LEADS[name]}][{_CONT[name]}�? ][{_CONT[name]}]|�[{_CONT[name]}]{{2}})(?:[{_HIGH[name]}]|[�? ](?=�?[{_HIGH[name]}]))*") for name in ENCODINGS}
# Cyrillic letters also stand for Latin ones: a span of theirs begins with a letter of the Indic blocks.
_SPANS["cp1251"] = re.compile(f"а[¤Ґ¦§](?:[{_HIGH['cp1251']}]|[�? ](?=�?[{_HIGH['cp1251']}]))+")
_ODD = re.compile(f"[^{PLAIN}]")
_ASCII = re.compile(r"[a-z][A-Z][a-z]*[&`_~|]|[A-Za-z]\?[a-z]")

# The legacy font's glyphs.
GLYPHS = {
    "A": "অ", "B": "ই", "C": "ঈ", "D": "উ", "E": "ঊ", "F": "ঋ", "G": "এ", "H": "ঐ", "I": "ও", "J": "ঔ",
    "K": "ক", "L": "খ", "M": "গ", "N": "ঘ", "O": "ঙ", "P": "চ", "Q": "ছ", "R": "জ", "S": "ঝ", "T": "ঞ",
    "U": "ট", "V": "ঠ", "W": "ড", "X": "ঢ", "Y": "ণ", "Z": "ত", "_": "থ", "`": "দ", "a": "ধ", "b": "ন",
    "c": "প", "d": "ফ", "e": "ব", "f": "ভ", "g": "ম", "h": "য", "i": "র", "j": "ল", "k": "শ", "l": "ষ",
    "m": "স", "n": "হ", "o": "ড়", "p": "ঢ়", "q": "য়", "r": "ৎ", "s": "ং", "t": "ঃ", "u": "ঁ",
    "v": "া", "w": "ি", "x": "ী", "y": "ু", "~": "ূ", "„": "ৃ", "…": "ৃ", "†": "ে", "‡": "ে", "ˆ": "ৈ", "‰": "ৈ", "Š": "ৗ",
    "&": "্", "ª": "্র", "«": "্র", "¨": "্য", "|": "।",
    "°": "ক্ক", "±": "ক্ট", "³": "ক্ত", "´": "ক্ম", "µ": "ক্র", "¶": "ক্ষ", "·": "ক্স", "¸": "গু", "Á": "জ্ঞ",
    "»": "গ্ধ", "¼": "ঙ্ক", "½": "ঙ্গ", "¾": "জ্জ", "¿": "ত্ত", "Â": "ঞ্চ", "Ã": "ঞ্ছ", "Ä": "ঞ্জ", "Æ": "ট্ট",
    "È": "ণ্ট", "É": "ণ্ঠ", "Ê": "ণ্ড", "Ë": "ত্ত", "Ì": "ত্থ", "Í": "ত্ম", "Î": "ত্র", "Ï": "দ্দ", "×": "দ্ধ",
    "Ø": "দ্ব", "Ù": "দ্ম", "Û": "ন্ড", "Ü": "ন্ধ", "Ý": "ন্স", "Þ": "প্ট", "ß": "প্ত", "à": "প্প", "ã": "ব্দ",
    "ä": "ব্ধ", "å": "ভ্র", "é": "ল্ক", "ê": "ল্গ", "ë": "ল্ট", "ì": "ল্ড", "í": "ল্প", "ï": "শু", "ð": "শ্চ",
    "ò": "ষ্ণ", "ó": "ষ্ট", "ô": "ষ্ঠ", "÷": "স্ট", "û": "হু", "ü": "হৃ", "ý": "হ্ন", "þ": "হ্ম", "¯": "স্",
}
_GLYPH = re.compile("[" + re.escape("".join(GLYPHS)) + "©0-9]+")
_CONSONANT = "[ক-হৎ]়?"
_CLUSTER = f"{_CONSONANT}(?:্{_CONSONANT})*"


def from_glyphs(text: str) -> str:
    """The text that the legacy font shows."""
    out = "".join(GLYPHS.get(c, c) for c in text)
    out = re.sub(f"([িেৈ])({_CLUSTER})", r"\2\1", out)  # these are drawn before their cluster
    out = re.sub(f"({_CLUSTER})©", r"র্\1", out)
    out = re.sub(f"({_CLUSTER})([ািীুূৃেৈ]+)©", r"র্\1\2", out)
    out = out.replace("অা", "আ")
    return unicodedata.normalize("NFC", out.translate({0x30 + k: 0x9E6 + k for k in range(10)}))


_WORD = re.compile(r"[^\s!-/:-@\[-`{-~।॥‘’“”]+")
_LOST = re.compile("�\\?�|\\?��|�\\?|\\?�|�")
_MARKS = re.compile(r"(?:(?<=^)|(?<=\s)|(?<=\s['\"“‘(])|(?<=^['\"“‘(]))\?{2,}(?=[\s,'\"’”;)!?।.]|$)")
_DAMAGED = re.compile(r"[^\s!-/:-@\[-`{-~।॥‘’“”]*�[^\s!-/:-@\[-`{-~।॥‘’“”]*")
_SIGNS = re.compile("[‡†ª¨©&`_~|]|[a-z][A-Z]")
_LETTERS = [chr(c) for c in range(0x980, 0xA00) if unicodedata.category(chr(c)) != "Cn"]


@lru_cache(100_000)
def letters(part: tuple[int | None, ...]) -> tuple[str, ...]:
    """The letters that bytes may be, a lost one shown as None."""
    found = []
    for value in (range(0xC2, 0xF5) if part[0] is None else range(0x80, 0xC0)) if None in part else (0,):
        try:
            letter = bytes(value if b is None else b for b in part).decode()
        except UnicodeDecodeError:
            continue
        if len(letter) == 1:
            found.append(letter)
    return tuple(found)


class Channel:
    """Reads texts under a list of words with their counts; or, with ``weights``
    (of the letter pairs) and ``fits`` (the word for each pattern of lost
    letters) taken from a table of words, under those and the counts asked for."""

    def __init__(self, counts: dict[str, int], weights: list[tuple[str, str, float]] | None = None, fits: dict[str, str] | None = None):
        self.counts = counts
        self.fits = fits
        self.pairs: dict[str, dict[str, float]] = {}
        self.memo: dict[str, str] = {}
        self.by_length: dict[int, list[str]] | None = None
        self.wanted: set[str] = set()  # patterns that were looked for
        if weights is not None:
            self.by_length = {}
            self._pairs(weights)

    def _model(self) -> None:
        """Letter pairs and words by length, made when first needed."""
        self.by_length = {}
        weights = []
        for word, n in sorted(self.counts.items(), key=lambda x: (-x[1], x[0])):
            self.by_length.setdefault(len(word), []).append(word)
            weights += [(a, b, 1 + math.log(n)) for a, b in zip("^" + word, word + "$")]
        self._pairs(weights)

    def _pairs(self, weights: list[tuple[str, str, float]]) -> None:
        for a, b, x in weights:
            own = self.pairs.setdefault(a, {})
            own[b] = own.get(b, 0) + x
        for a, own in self.pairs.items():
            total = sum(own.values()) + 100
            self.pairs[a] = {b: math.log(x / total) for b, x in own.items()}

    def pair(self, a: str, b: str) -> float:
        return self.pairs.get(a, {}).get(b, -9.0)

    # -- bytes shown by a wrong decoder ---------------------------------

    @staticmethod
    def strict(shown: str, name: str) -> str | None:
        """The reading of a span that lost nothing, or None."""
        table = BYTES[name]
        try:
            return " ".join(bytes(table[c] for c in piece).decode() for piece in shown.split(" "))
        except (KeyError, UnicodeDecodeError):
            return None

    def span(self, shown: str, name: str) -> str | None:
        """The best reading of a span, or None where it has none.  A lattice
        without lost bytes is one path, which is decoded at once; else it is
        searched, and words with wildcards are read as the most frequent word of
        the corpus that fits them."""
        whole = self.strict(shown, name)
        if whole is not None:
            return whole
        table = BYTES[name]
        if self.by_length is None:
            self._model()
        path = self._viterbi(shown, [table.get(c) if c not in "�? " else None for c in shown])
        if path is None:
            return None
        found = self._words(path)
        before, after = (sum(c in table for c in t) for t in (shown, found))
        return found if after * 2 <= before else None

    def _viterbi(self, shown: str, lattice: list[int | None]) -> list[tuple[str, tuple[str, ...]]] | None:
        """The best path through the bytes: pieces with the letters that each
        could also be.  A state is a place and the letter before it."""
        best: list[dict[str, tuple]] = [{"^": (0.0, 0, "", "", ())}] + [{} for _ in shown]

        def offer(at: int, last: str, score: float, came: int, state: str, piece: str, others: tuple[str, ...]) -> None:
            own = best[at]
            if last not in own or score > own[last][0]:
                own[last] = (score, came, state, piece, others)

        for i, c in enumerate(shown):
            steps: list[tuple[int, tuple[str, ...], float]] = []
            for size in (2, 3, 4):
                part = lattice[i : i + size]
                lost = part.count(None)
                if len(part) == size and lost <= 1 and (some := self._known(letters(tuple(part))) if lost else letters(tuple(part))):
                    steps.append((size, some, -2.0 * lost))
            part = lattice[i : i + 2]
            if len(part) == 2 and None not in part and 0xE0 <= part[0] <= 0xE3 and part[1] < 0xC0:  # one byte was dropped without a trace
                if some := self._known(letters((*part, None)) + letters((part[0], None, part[1]))):
                    steps.append((2, some, -6.0))
            for state, (score, *_) in best[i].items():
                offer(i + 1, "^" if c == " " else c, score - (1.0 if c in "? " else 14.0), i, state, c, ())
                for size, some, price in steps:
                    others = some if len(some) > 1 else ()
                    for letter in some:
                        offer(i + size, letter, score + self.pair(state, letter) + price, i, state, letter, others)
        if not best[-1]:
            return None
        path, at, state = [], len(shown), max(best[-1], key=lambda k: (best[-1][k][0], k))
        while at:
            _, came, before, piece, others = best[at][state]
            path.append((piece, others))
            at, state = came, before
        return path[::-1]

    def _known(self, some: tuple[str, ...]) -> tuple[str, ...]:
        """Those of the letters that a lost byte may have been that words of the corpus have."""
        return tuple(x for x in some if x in self.pairs)

    def _words(self, path: list[tuple[str, tuple[str, ...]]]) -> str:
        """The text of a path, its words with wildcards under the counts of words."""
        out, word = [], []
        for piece, others in [*path, (" ", ())]:
            if _WORD.fullmatch(piece):
                word.append((piece, others))
                continue
            if word:
                pattern = "".join("�" if o else p for p, o in word)
                plain = "".join(p for p, _ in word)
                gaps = pattern.count("�")
                if gaps and gaps * 2 <= len(pattern):
                    self.wanted.add(pattern)
                    whole = self._fit(pattern)
                    if whole and all(not o or w in o for w, (_, o) in zip(whole, word)):
                        plain = whole
                out.append(plain)
                word = []
            out.append(piece)
        return "".join(out)[:-1]

    def _fit(self, pattern: str) -> str | None:
        """The most frequent word that fits a pattern, � standing for any letter."""
        if self.fits is not None:
            return self.fits.get(pattern)
        fits = re.compile("".join("." if c == "�" else re.escape(c) for c in pattern)).fullmatch
        return next((w for w in self.by_length.get(len(pattern), ()) if fits(w)), None)

    def _spans(self, text: str, name: str, read) -> tuple[str, int]:
        """The text with what ``read`` makes of the spans; the characters that this saved."""
        saved = 0

        def put(m: re.Match) -> str:
            nonlocal saved
            shown = m[0].rstrip("? ")
            got = read(shown, name)
            if got is None:
                return m[0]
            saved += len(shown) - len(got)
            return got + m[0][len(shown) :]

        return _SPANS[name].sub(put, text), saved

    def _readable(self, text: str, name: str) -> int:
        """How many letters of the corpus a decoder's spans hold, lost bytes passed over."""
        if self.by_length is None:
            self._model()
        table = BYTES[name]
        bytes_ = b"".join(bytes(table[c] for c in m[0] if c in table) for m in _SPANS[name].finditer(text))
        return sum(c in self.pairs for c in bytes_.decode(errors="ignore"))

    def decoders(self, text: str) -> str:
        """The text with the spans of wrong decoders put right, twice where they were twice decoded."""
        for _ in range(3):
            found = [(self._spans(text, name, self.strict), name) for name in ENCODINGS if _SPANS[name].search(text)]
            if not found:
                return text
            # the decoder under which most letters of the corpus are read, then the one that saves most characters
            (new, saved), name = max(found, key=lambda x: (self._readable(text, x[1]) if len(found) > 1 else 0, x[0][1]))
            if _SPANS[name].search(new):
                more, by = self._spans(new, name, self.span)
                new, saved = (more, saved + by) if by > 0 else (new, saved)
            if saved <= 0:
                return text
            text = new
        return text

    # -- glyphs of a legacy font ----------------------------------------

    @staticmethod
    def spellings(part: str) -> tuple[str, tuple[str, ...]]:
        """A word without outer marks; its reading as glyphs and its plain spellings, none where it can't be glyphs."""
        core = part.strip("!,.?;:'\"()")
        if len(core) < 2 or not _GLYPH.search(core) or not re.search("[A-Za-z`_]", core):
            return core, ()
        return core, (from_glyphs(core).strip("।"), core, core.lower(), core.capitalize())

    def glyphs(self, text: str) -> str:
        """Runs of words that are glyphs, as letters: their reading is made of
        words of the corpus, or has the font's own signs, and they aren't words."""
        parts = re.split(r"(\s+)", text)
        evidence = []
        for part in parts[::2]:
            core, spellings = self.spellings(part)
            if not spellings:
                evidence.append((0.0, core))
                continue
            read = spellings[0]
            n, *other = (self.counts.get(w, 0) for w in spellings)
            plain = sum(other)
            signs = len(re.findall("[‡†ª¨©]|[a-z`_][A-Z]|&[a-z`_A-Z]|[`_~|]", core))
            letters = len(re.findall("[A-Za-z]", core))
            sane = not re.search("[A-Za-z]|^[া-ৗ]|[া-ৌ][া-ৌ]", read)
            score = math.log((n + 0.3) / (plain + 0.3)) + (1.5 * signs if sane else -3) + (0 if letters else -2)
            evidence.append((max(-4.0, min(score, 6.0)), core))
        # the best set of runs by Viterbi over two states: entering costs, so single chance words stay
        plain_score, glyph_score, back = 0.0, -7.0, []
        for score, _ in evidence:
            a, b = (plain_score, 0), (glyph_score - 1, 1)
            c, d = (plain_score - 7.0, 0), (glyph_score, 1)
            stay, enter = max(a, b), max(c, d)
            back.append((stay[1], enter[1]))
            plain_score, glyph_score = stay[0], enter[0] + score
        state = int(glyph_score > plain_score)
        states = []
        for stay, enter in reversed(back):
            states.append(state)
            state = enter if state else stay
        states.reverse()
        if 1 not in states:
            return text
        return "".join(from_glyphs(p) if k % 2 == 0 and states[k // 2] and _GLYPH.search(p) else p for k, p in enumerate(parts))

    # -- lost letters -----------------------------------------------------

    def _alphabet(self, word: str) -> list[str]:
        """What a lost letter of a word may be: the letters of the word's script
        that words of the corpus have; in Latin words those with accents, as
        no single byte is lost to decoding."""
        blocks = {ord(c) >> 7 for c in word if c != "�"}
        if 0x13 in blocks or not blocks:
            return _LETTERS
        if 0 in blocks:
            blocks = {1, 2, 3}
        return sorted(c for c in self.pairs if ord(c) >> 7 in blocks and unicodedata.category(c)[0] in "LM")

    def lost(self, word: str) -> str:
        """A word with lost letters, each shown as �: the most frequent word
        that fits, else the best letters by pairs, else the word as it is."""
        if word in self.memo:
            return self.memo[word]
        if self.by_length is None:
            self._model()
        gaps = word.count("�")
        found = word
        if gaps * 2 <= len(word):
            if whole := self._fit(word):
                found = whole
            elif gaps * 4 <= len(word):
                best = {"^": (0.0, "")}
                alphabet = self._alphabet(word)
                for c in word + "$" if alphabet else "":
                    new: dict[str, tuple[float, str]] = {}
                    for b in alphabet if c == "�" else [c]:
                        new[b] = max((s + self.pair(a, b), t + (b if b != "$" else "")) for a, (s, t) in best.items())
                    best = new
                found = best["$"][1] if alphabet else word
        if len(self.memo) < 100_000:
            self.memo[word] = found
        return found

    def asked(self, text: str) -> tuple[set[str], set[str]]:
        """What reading a text asks of the table of words: words for their
        counts, patterns of lost letters for the word that fits."""
        words: set[str] = set()
        if not (_ODD.search(text) or "??" in text or _ASCII.search(text)):
            return words, set()
        self.wanted = set()
        new = self.decoders(text)
        shown = [new]
        if _SIGNS.search(new):
            parts = re.split(r"\s+", new)
            words.update(w for p in parts for w in self.spellings(p)[1])
            shown.append(" ".join(map(from_glyphs, parts)))
        patterns = {m[0] for t in shown if "�" in t for m in _DAMAGED.finditer(_LOST.sub("�", t))}
        return words, {p for p in patterns | self.wanted if p.count("�") * 2 <= len(p)}

    def restore(self, text: str) -> tuple[str, bool]:
        """The text as it was, as far as that can be told, and whether it was garbled."""
        if not _ODD.search(text) and "??" not in text and not _ASCII.search(text):
            return text, False
        new = self.decoders(text)
        if _SIGNS.search(new):
            new = self.glyphs(new)
        found = new != text or "�" in new
        if "�" in new:
            shown = _LOST.sub("�", new)
            new = _DAMAGED.sub(lambda m: self.lost(m[0]), shown)
        if not found and "??" in text:
            runs = list(_MARKS.finditer(text))
            inside = [m for m in runs if re.search(r"\w", text[m.end() :])]
            found = len(runs) >= 2 or bool(inside)
        return new, found


#: What ``Channel.restore`` and ``asked`` look at; other texts stay as they are.
_SUSPECT = "[^" + PLAIN.replace(r"\U0001f300-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff", r"\x{1f300}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f900}-\x{1f9ff}") + r"]|\?\?|" + _ASCII.pattern


def _weights(words: DataFrame) -> list[tuple[str, str, float]]:
    """The weight of each letter pair over all words, in millionths while summed, so that their order doesn't matter."""
    ends = F.concat(F.lit("^"), "w", F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda k: F.substring(ends, k, F.lit(2)))
    one = words.select(F.explode(pairs).alias("p"), F.round((1 + F.log("count")) * 1e6).cast("long").alias("x"))
    return [(r.p[0], r.p[1], r.x / 1e6) for r in one.groupBy("p").agg(F.sum("x").alias("x")).orderBy("p").collect()]


def _fits(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, w): for each pattern the most frequent word that fits, of equals the
    first by spelling.  They meet by length and the pattern's longest known piece."""
    patterns = patterns.select("key", F.length("key").alias("size"), "start", "piece")
    shapes = patterns.select("size", "start", F.length("piece").alias("wide")).distinct()
    pieces = words.withColumn("size", F.length("w")).join(F.broadcast(shapes), "size").select("w", "count", "size", "start", F.substring("w", F.col("start"), F.col("wide")).alias("piece"))
    both = pieces.join(patterns, ["size", "start", "piece"]).where(F.expr("w LIKE replace(key, '�', '_')"))
    return both.groupBy("key").agg(F.min(F.struct(-F.col("count"), "w")).alias("b")).select("key", "b.w")


def _longest(pattern: str) -> tuple[int, str]:
    """Where the longest known piece of a pattern starts, from 1, and the piece."""
    m = max(re.finditer("[^�]+", pattern), key=lambda m: len(m[0]))
    return m.start() + 1, m[0]


def tables(df: DataFrame, text: str = "text") -> tuple[dict[str, int], list[tuple[str, str, float]], dict[str, str]]:
    """What a ``Channel`` needs to read the texts of ``df`` under the counts of
    all their recurring words: the counts asked for, the pairs, the fitting words."""
    words = common.cut(counted(df, text), "words")
    weights = _weights(words)
    pairs = df.sparkSession.sparkContext.broadcast(weights)
    key = common.fresh_key()
    schema = pa.schema([("key", pa.string()), ("start", pa.int32()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = common.kept(key, lambda: Channel({}, pairs.value, {}))
        for batch in batches:
            known: set[str] = set()
            lost: set[str] = set()
            for t in common.column(batch, "text"):
                a, b = channel.asked(t)
                known |= a
                lost |= b
            out = [(w, 0, None) for w in known] + [(p, *_longest(p)) for p in lost]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = common.rows_of(df.where(F.col(text).rlike(_SUSPECT)), text=F.col(text))
    asked = common.cut(rows.mapInArrow(run, "key string, start int, piece string").distinct(), "asked")
    counts = asked.where("start = 0").join(words, F.col("key") == F.col("w")).select("w", "count")
    return {r[0]: r[1] for r in counts.collect()}, weights, {r[0]: r[1] for r in _fits(words, asked.where("start > 0")).collect()}


def restored(df: DataFrame, text: str = "text", out: str = "restored_text", flag: str = "garbled") -> DataFrame:
    """Adds ``out`` and ``flag``: the text as it was and whether it was garbled.
    Columns of these names that ``df`` already has are replaced."""
    common.ship(df.sparkSession)
    read_under = df.sparkSession.sparkContext.broadcast(tables(df, text))
    key = common.fresh_key()

    @F.pandas_udf("text string, garbled boolean")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        channel = common.kept(key, lambda: Channel(*read_under.value))
        for texts in batches:
            both = [(None, None) if t is None else channel.restore(t) for t in texts]
            yield pd.DataFrame(both, columns=["text", "garbled"], index=texts.index).astype({"text": object})

    return df.withColumn("_read", read(F.col(text))).withColumns({out: F.col("_read.text"), flag: F.coalesce("_read.garbled", F.lit(False))}).drop("_read")


def garbled(df: DataFrame, id_col: str = "internal_id", text: str = "text") -> DataFrame:
    """(id_col, restored_text): the garbled texts of four words or more."""
    common.ship(df.sparkSession)
    read_under = df.sparkSession.sparkContext.broadcast(tables(df, text))
    key = common.fresh_key()
    schema = pa.schema([("id", pa.int64()), ("restored_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = common.kept(key, lambda: Channel(*read_under.value))
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(common.column(batch, "id"), common.column(batch, "text")):
                if len(t.split(None, 4)) >= 4:
                    new, found = channel.restore(t)
                    if found:
                        out.append((i, new))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = common.rows_of(df, id=F.col(id_col).cast("long"), text=F.col(text)).where("text is not null and id is not null")
    return rows.mapInArrow(run, "id long, restored_text string").withColumnRenamed("id", id_col)
