"""Problem 2: personal information inside free text.

Bootstrapped contextual extraction.  Seed entities (pairs of a given and a
family name of the gazetteer; numbers that stand behind a seed word) induce
lexical patterns, the words left and right of them.  Spark scores the graph of
patterns and instances in rounds: a pattern is as good as the instances it
meets, an instance as the best of its patterns.  Names that good patterns show
beside a known one join the lists, and patterns that meet numbers of the
shapes of identity numbers join the seeds; then one pass over the texts puts
typed placeholders in place of what is found.

E-mail addresses (also written around the @ or the dots) and full phone
numbers are told by their own form, postal addresses by two parts or more in a
row (house, road, block, floor, ward, village, post office, numbered street)
with a place behind.

Null text gives null; empty and blank texts stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .lookalike import _IGNORABLE, _TABLE, SEQUENCES

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
ROUNDS = 3
GOOD = 0.5  # the least confidence of a pattern
NAME = 0.25  # and of a found name
BOTH = 0.7  # the least confidence of each of the two patterns that show a name
# Seed words of identity numbers.
ID_SEEDS = (
    "nid", "এনআইডি", "national id", "জাতীয় পরিচয়পত্র", "voter id", "ভোটার আইডি", "id card number", "আইডি কার্ডের নম্বর",
    "passport", "পাসপোর্ট", "birth certificate", "birth reg", "জন্ম নিবন্ধন", "জন্মসনদ",
)
ID_LENGTHS = (10, 13, 17)  # digits of the identity numbers

_FOLD = {k: v for k, v in _TABLE.items() if len(v) == 1} | {base + k: str(k) for base in (0x9E6, 0x966) for k in range(10)}
_AT = r"(?:\s*@\s*|\s*[\[({]\s*(?:at|AT|অ্যাট|এট|অ্যাট)\s*[\])}]\s*|\s+(?:at|AT|অ্যাট|এট)\s+)"
_DOT = r"(?:\s*[\[({]\s*(?:dot|DOT|ডট)\s*[\])}]\s*|\s+(?:dot|DOT|ডট)\s+|\.)"
_EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._+\-]*{_AT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
_NUMBER = re.compile(r"(?<![A-Za-z0-9=/._#\-])(?:[A-Za-z]{1,2}\d{7}|\+?\(?\d(?:[\-. ()]{0,2}\d){6,})(?![A-Za-z0-9/])")
_WORD = re.compile(r"[ঀ-৿‌‍]+|[A-Za-z]+(?:['’][a-z]+)?")

_N = r"\d{1,4}(?:/\d{1,4})?"
_PLACE = r"[ঀ-৥A-Za-z]{3,}"
_UNIT = rf"(?:বাসা|বাড়ি|হোল্ডিং|ফ্ল্যাট|রোড|ওয়ার্ড|প্লট|সেক্টর|House|Road|Flat|Holding|Ward|Plot|Sector|house|road|flat|holding|ward|plot|sector|HOUSE|ROAD|FLAT|HOLDING|WARD|Basa|basa)(?:\s*(?:নং|নম্বর|no\.?|No\.?|#))?\s*[:\-]?\s*\d{{1,4}}[A-Za-z]?\b"
_BLOCK = r"(?:ব্লক|Block|block|BLOCK)\s*[:\-]?\s*[A-Za-zক-হ]\b"
_FLOOR = r"\d{1,2}(?:st|nd|rd|th)?\s*(?:তলা|তলায়|floor|Floor|tola)"
_STREET = r"(?:লেন|রোড|সড়ক|স্ট্রিট|গলি|এভিনিউ|Lane|Road|Street|Sarak|Avenue|Goli|lane|street|sarak|avenue|LANE|STREET|SARAK)"
_LANE = rf"{_N}\s*(?:নং|নম্বর|no\.?)?,?\s+{_PLACE}\s+{_STREET}"
_NAMED = rf"{_PLACE}\s+(?:{_STREET}|টাওয়ার|ভবন|ম্যানশন|Tower|tower|TOWER|Bhaban|Mansion)"
_LABEL = rf"(?:গ্রাম|ডাকঘর|উপজেলা|থানা|জেলা|vill|village|post|upazila|thana|district|Vill|Village|Post|Upazila|Thana|District|VILL|POST|UPAZILA|gram|dakghor|upojela)\s*[:.\-]\s*{_PLACE}"
_PART = f"(?:{_UNIT}|{_BLOCK}|{_FLOOR}|{_LANE}|{_NAMED}|{_LABEL})"
_END = rf"(?:{_PLACE}(?:[\-\s]\d{{4}}\b)?)"
_ADDRESS = re.compile(rf"(?<![A-Za-zঀ-৿\d/]){_PART}(?:\s*,\s*{_PART})*(?:\s*,\s*{_END})?", re.I)
_FIRM = re.compile(f"{_UNIT}|{_BLOCK}|{_FLOOR}|{_LANE}|{_LABEL}", re.I)
# A word of these stands in every address.
_CUES = ("রোড", "লেন", "সড়ক", "ওয়ার্ড", "ব্লক", "তলা", "ডাকঘর", "গলি", "স্ট্রিট", "সেক্টর", "এভিনিউ", "উপজেলা", "থানা", "road", "lane", "street", "sarak", "ward", "block", "sector", "post", "upazila", "thana", "floor", "tola", "avenue", "goli", "dakghor")


_RARE = re.compile("[\u09dc\u09dd\u09df\u0958-\u095f]|ে[াৗ]|অা|ত্‍|" + _IGNORABLE.pattern)


_FOLDS = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_FOLD)) + "]")


def folded(text: str) -> tuple[str, list[int] | None, list[int]]:
    """The text with plain digits, letters and spaces, canonical sequences and
    no ignorables; where each of its characters starts and ends in the text
    (None: at the same place)."""
    plain = text.translate(_FOLD) if _FOLDS.search(text) else text
    if not _RARE.search(plain):
        return plain, None, []
    out, starts, ends, last = [], [], [], 0
    for m in _RARE.finditer(plain):
        out.append(plain[last : m.start()])
        starts += range(last, m.start())
        ends += range(last + 1, m.start() + 1)
        if not _IGNORABLE.match(m[0]):
            part = SEQUENCES.get(m[0]) or unicodedata.normalize("NFC", m[0])
            out.append(part)
            starts += [m.start()] * len(part)
            ends += [m.end()] * len(part)
        last = m.end()
    out.append(plain[last:])
    starts += range(last, len(plain))
    ends += range(last + 1, len(plain) + 1)
    return "".join(out), starts, ends


def shape(number: str) -> str:
    """What a number looks like: "phone", "p7" for two letters and seven digits, or how many digits it has."""
    digits = re.sub(r"\D", "", number)
    if number[0].isalpha():
        return "p7" if number[:2].isalpha() else "p"
    if re.fullmatch(r"(?:(?:00)?880|0)1\d{9}", digits):
        return "phone"
    return str(len(digits))


def _tail(text: str, words: int = 2) -> list[str]:
    """The last words of a text in lower case, marks kept but quotes."""
    last = text.rsplit(None, words + 2)[-words - 2 :]  # quotes alone may be words
    return re.sub(r"['\"“”‘’]", " ", " ".join(last)).lower().split()[-words:]


def number_pattern(text: str, start: int) -> list[str]:
    """The patterns left of a number: one word and two."""
    words = [w.strip(".:;,।!?()-|#") for w in _tail(text[:start], 3)]
    words = [w for w in words if w]
    return [" ".join(words[-k:]) for k in (1, 2) if len(words) >= k]


def is_seed(text: str, start: int) -> bool:
    """Whether a seed word of identity numbers stands close to the left."""
    left = " ".join(re.sub(r"[:.,;।!?#]", " ", text[max(0, start - 40) : start].lower()).split())
    return any(left.find(s, max(0, len(left) - len(s) - 12)) >= 0 for s in ID_SEEDS)


def name_patterns(text: str, start: int, end: int) -> list[str]:
    """The patterns beside a pair of words: one word and two, left and right."""
    left, right = text[:start], text[end:]
    before = left.replace("\n", " ⏎ ").rsplit(None, 2)[-2:]
    after = right.replace("\n", " ⏎ ").split(None, 2)[:2]
    before, after = [w.lower() for w in before], [w.lower() for w in after]
    out = []
    if left.endswith((" ", "\n", "'", '"', "(")) or not left:
        out += ["<" + " ".join(before[-k:]) for k in (1, 2) if len(before) >= k] or ["<^"]
    if right[:1] in ("", " ", "\n", ".", ",", "।", ";", "|", "!"):
        out += [" ".join(after[:k]) + ">" for k in (1, 2) if len(after) >= k] or ["$>"]
    return out


def pairs_of(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Neighbouring words of one script with one blank between them."""
    words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]
    for (a, s, e), (b, s2, e2) in zip(words, words[1:]):
        if s2 == e + 1 and text[e] == " " and a[0].isascii() == b[0].isascii():
            yield a, b, s, e2


class Finder:
    """Finds the spans of personal information under lists of names (in lower
    case) and patterns."""

    def __init__(self, given: set[str], family: set[str], names: dict[str, float], ids: dict[str, float], ordinary: set[str] = frozenset()):
        self.given, self.family, self.names, self.ids, self.ordinary = given, family, names, ids, ordinary
        self.either = given | family

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        plain, starts, ends = folded(text)
        found: list[tuple[int, int, str]] = []
        if "@" in plain or " at " in plain or "[" in plain or "(at" in plain or "অ্যাট" in plain or " এট " in plain:
            found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(plain)]
        if any(map(plain.__contains__, "0123456789")):
            for m in _NUMBER.finditer(plain):
                s = shape(m[0])
                if s == "phone":
                    found.append((m.start(), m.end(), "phone"))
                elif s in ("p7", "p") or (s.isdigit() and int(s) in ID_LENGTHS):
                    if is_seed(plain, m.start()) or any(self.ids.get(p, 0) >= GOOD for p in number_pattern(plain, m.start())):
                        found.append((m.start(), m.end(), "id_number"))
        low = plain.lower()
        if any(map(low.__contains__, _CUES)):
            for m in _ADDRESS.finditer(plain):
                parts = re.split(r"\s*,\s*", m[0])
                firm = sum(bool(_FIRM.fullmatch(p)) for p in parts)
                if len(parts) >= 2 and firm and not (firm == 1 and re.fullmatch(_FLOOR, parts[0], re.I)):
                    found.append((m.start(), m.end(), "address"))
                elif len(parts) == 1 and re.fullmatch(_LANE, m[0], re.I):
                    found.append((m.start(), m.end(), "address"))
        if len(low) != len(plain):
            low = plain
        if not self.either.isdisjoint(_WORD.findall(low)):
            for a, b, s, e in pairs_of(low):
                if a in self.given and b in self.family:
                    found.append((s, e, "name"))
                elif (a in self.given and a not in self.ordinary) or b in self.family:
                    best = sorted((self.names.get(p, 0.0) for p in name_patterns(plain, s, e)), reverse=True)
                    if len(best) > 1 and best[1] >= BOTH:
                        found.append((s, e, "name"))
        out, end = [], -1
        for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1])):
            if s >= end:
                out.append((s, e, kind))
                end = e
        return out if starts is None else [(starts[s], ends[e - 1], kind) for s, e, kind in out]

    def masked(self, text: str) -> str:
        out, last = [], 0
        for s, e, kind in self.spans(text):
            out += [text[last:s], PLACEHOLDER[kind]]
            last = e
        return "".join(out) + text[last:]


# -- the graph of patterns and instances ------------------------------------

_EDGE = "kind string, a string, b string, known int, patterns array<string>"


def instances(df: DataFrame, given: set[str], family: set[str], text: str = "text") -> DataFrame:
    """Instances with their patterns: pairs of words of which the gazetteer has
    one or both, and long numbers; equal ones counted (``n``)."""
    common.ship(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast((given, family))
    schema = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("known", pa.int32()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, family = known.value
        either = given | family
        for batch in batches:
            out: list[tuple] = []
            for t in common.column(batch, "text"):
                plain = folded(t)[0]
                low = plain.lower()
                if not either.isdisjoint(_WORD.findall(low)):
                    for a, b, s, e in pairs_of(low):
                        g, f = a in given, b in family
                        if g or f:
                            out.append(("name", a, b, g + 2 * f, name_patterns(low, s, e)))
                if any(map(plain.__contains__, "0123456789")):
                    for m in _NUMBER.finditer(plain):
                        if (s := shape(m[0])) != "phone":
                            out.append(("number", s, "", int(is_seed(plain, m.start())), number_pattern(plain, m.start())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = common.rows_of(df, text=F.col(text)).where("text is not null")
    return rows.mapInArrow(run, _EDGE).groupBy("kind", "a", "b", "known", "patterns").agg(F.count("*").alias("n"))


def scored(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kind, pattern, confidence, n); of the unknown halves of name pairs (role,
    word, confidence, n); (partner, trust) of the known ones, after some rounds
    over the graph."""
    edges = common.cut(edges.withColumn("id", F.xxhash64("kind", "a", "b", "known", "patterns")), "edges")
    shapes = edges.where("kind = 'number'").groupBy("a").agg((F.sum(F.col("n") * F.col("known")) / F.sum("n")).alias("c"))
    conf = edges.where("kind = 'name'").select("id", (F.col("known") == 3).cast("double").alias("c"))
    conf = conf.unionByName(edges.where("kind = 'number'").join(shapes, "a").select("id", F.greatest("c", F.col("known").cast("double")).alias("c")))
    long = edges.select("id", "kind", "n", F.explode("patterns").alias("pattern"))
    words = None
    for _ in range(rounds):
        pattern = long.join(conf, "id").groupBy("kind", "pattern").agg((F.sum(F.col("c") * F.col("n")) / (F.sum("n") + 1)).alias("confidence"), F.sum("n").alias("n"))
        best = long.where("kind = 'name'").join(pattern.select("kind", "pattern", "confidence"), ["kind", "pattern"]).groupBy("id").agg(F.max("confidence").alias("p"))
        # a known name that is mostly an ordinary word says little of its neighbour
        sides = edges.where("kind = 'name'").select("id", "n", F.explode(F.expr("filter(array(if(known & 1 = 1, a, null), if(known & 2 = 2, b, null)), x -> x is not null)")).alias("partner"))
        trust = common.cut(sides.join(conf, "id").groupBy("partner").agg(((F.sum(F.col("c") * F.col("n")) + 1) / (F.sum("n") + 2)).alias("trust")), "trust")
        first = F.col("known") == 1
        half = edges.where("kind = 'name' and known in (1, 2)").select(
            "id", "n", F.when(first, F.lit("family")).otherwise(F.lit("given")).alias("role"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("word"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("partner"))
        words = half.join(best, "id").join(trust, "partner").groupBy("role", "word").agg((F.sum(F.col("p") * F.least(F.lit(1.0), F.col("trust") * 5) * F.col("n")) / F.sum("n")).alias("confidence"), F.sum("n").alias("n"))
        words = common.cut(words, "words")
        names = half.join(words.select("role", "word", F.col("confidence").alias("c")), ["role", "word"]).select("id", F.when(F.col("c") >= NAME, F.col("c")).otherwise(0.0).alias("c"))
        rest = conf.join(names.select("id"), "id", "left_anti")
        conf = common.cut(rest.unionByName(names), "confidence")
    return pattern, words, trust


def finder(df: DataFrame, gazetteer: DataFrame, text: str = "text") -> tuple[Finder, DataFrame, DataFrame]:
    """A finder with the gazetteer's names, the names found and the good
    patterns, and the tables of patterns and of found words.

    All found names count, and all good patterns from three instances on,
    however large the table; only patterns that decide nothing (of names those
    under BOTH) aren't broadcast."""
    listed = gazetteer.where("kind in ('given_name', 'family_name') and entry is not null").select("kind", "entry").distinct().collect()
    given = {folded(r.entry)[0].lower() for r in listed if r.kind == "given_name"}
    family = {folded(r.entry)[0].lower() for r in listed if r.kind == "family_name"}
    pattern, words, trust = scored(instances(df, given, family, text))
    ordinary = {r.partner for r in trust.where("trust < 0.2").collect()}
    pattern = common.cut(pattern, "patterns")
    good = pattern.where(F.col("confidence") >= F.when(F.col("kind") == "name", BOTH).otherwise(GOOD)).where("n >= 3").collect()
    new = words.where(F.col("confidence") >= NAME).collect()
    own = {"name": {}, "number": {}}
    for r in good:
        own[r.kind][r.pattern] = r.confidence
    given |= {r.word for r in new if r.role == "given"}
    family |= {r.word for r in new if r.role == "family"}
    return Finder(given, family, own["name"], own["number"], ordinary), pattern, words


def found(df: DataFrame, gazetteer: DataFrame, id_col: str = "internal_id", text: str = "text") -> DataFrame:
    """(id_col, pii_type): the types that occur in each text of four words or more."""
    sc = df.sparkSession.sparkContext
    own = sc.broadcast(finder(df, gazetteer, text)[0])
    schema = pa.schema([("id", pa.int64()), ("pii_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in zip(common.column(batch, "id"), common.column(batch, "text")):
                if len(t.split(None, 4)) >= 4:
                    out += [(i, kind) for kind in sorted({kind for _, _, kind in own.value.spans(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = common.rows_of(df, id=F.col(id_col).cast("long"), text=F.col(text)).where("text is not null and id is not null")
    return rows.mapInArrow(run, "id long, pii_type string").withColumnRenamed("id", id_col)


def masked(df: DataFrame, gazetteer: DataFrame, text: str = "text", out: str = "masked_text") -> DataFrame:
    """Adds ``out``, the text with placeholders.  A column of that name is replaced."""
    own = df.sparkSession.sparkContext.broadcast(finder(df, gazetteer, text)[0])

    @F.pandas_udf("string")
    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(own.value.masked, na_action="ignore")

    return df.withColumn(out, mask(F.col(text)))
