"""Problem 10: texts cut off before their end, in SQL.

Word trigrams are counted over all texts: inside sentences, where more words
follow, and at their ends (before a final mark, a line break, an emoji, a
hashtag, a link).  Words below a share of all tokens (names, pieces of words)
are one class, ``*``, in the trigrams.  The trigram that ends an open text (one
without a final mark, emoji, hashtag or link at its end) is joined to these
counts: frequent inside but almost never terminal, it shows that the text was
cut.  The counts are rolled up for what is too rare to tell: a trigram with any
last word, the pair, the pair with any last word, the word.

A last word outside the vocabulary is a piece of a word where the corpus has a
trigram (or pair) that goes on with a longer word beginning with it; a broken
character at the end is such a piece, empty where nothing precedes it.  Dots at
the end and a mark of the cutting behind them ("read more") are taken off
first and tell nothing by themselves.  A text of three words or fewer is often
a stock phrase that ends without a mark: where it recurs whole its copies count
as ends of its trigram, and only trigrams that hold a word of context decide.
Of what no count tells (fewer than ``LEAST`` places) only pieces of words of the
vocabulary are reported.

Null, empty and blank texts are no cases.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from . import common

# What follows the dots where a text was cut.
MARKS = ("আরও পড়ুন", "আরো পড়ুন", "আরও দেখুন", "আরো দেখুন", "আরও", "আরো", "বিস্তারিত", "read more", "see more", "show more", "continue reading", "more", "aro porun", "aro dekhun", "aro", "और पढ़ें", "और देखें", "थप पढ्नुहोस्", "অধিক পঢ়ক")
RARE = 50  # an ending of a cut text ends a sentence in at most one of so many of its places
LEAST = 4  # places that a trigram, pair or word must have to tell
SHARE = 100_000  # the vocabulary: words of one in so many tokens or more, hence at most so many words, which are broadcast; 131,070 at most, as numbers of 17 bits

EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
_MARKS = "|".join(MARKS).replace("য়", "(?:য়|য়)").replace("ড়", "(?:ড়|ড়)").replace("ঢ়", "(?:ঢ়|ঢ়)").replace("ढ़", "(?:ढ़|ढ़)")
# Blanks; marks that end a sentence; other marks, which go.  A comma is a token.
BLANKS, ENDS, OTHERS = " \t\x0b\f     　\n\r​‎‏⁠﻿­", "।॥.!?…\n\r", "\t\x0b\f     　;:\"()[]|“”‘’—–'­​‎‏⁠﻿"
FINAL = "।॥!?."
CUT_MARK = rf"(?i)(?:\.\.+|…)\s*(?:{_MARKS})$"
DOTS = r"(?:\.\.+|…|\s\.)+$"
CLOSERS = "[\"”’)\\]'»" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS) + "]+$"
LINKED = r"(?:^|\s)(?:#\S+|https?://\S+)$"
ENDING = "(d = '¶' OR d LIKE '#%' OR d LIKE 'http%' OR ascii(d) BETWEEN 9728 AND 10175 OR ascii(d) >= 126976)"


def _quoted(x: str) -> str:
    return "'" + "".join("\\\\" if c == "\\" else "\\'" if c == "'" else f"\\u{ord(c):04x}" if ord(c) < 32 or 0x7F <= ord(c) < 0xB0 or 0x2000 <= ord(c) < 0x2070 or c == "﻿" else c for c in x) + "'"


def _regex(x: str) -> str:
    return 'r"' + x.replace('"', r"\x22") + '"'


_SHUT = ", ".join(_quoted(c) for c in "\"”’)]'»" + BLANKS)
# A text without what stands behind its last word or mark, step by step (a pattern is tried only where its first character is there).
TEXTS = f"""SELECT id, source, open, if(x = '', array(), split(x, ' +')) AS w FROM (SELECT id, source,
        NOT (CASE WHEN right(t, 1) IN ({_SHUT}) THEN right(regexp_replace(t, {_regex(CLOSERS)}, ''), 1) ELSE right(t, 1) END IN ('।', '॥', '!', '?', '.')
            OR right(t, 1) RLIKE {_regex("^" + EMOJI)} OR ((contains(t, '#') OR contains(t, 'http')) AND substring_index(t, ' ', -1) RLIKE {_regex(LINKED)})) AS open,
        trim(replace(replace(translate(lower(t), {_quoted(ENDS + OTHERS)}, {_quoted("¶" * len(ENDS) + " " * len(OTHERS))}), '¶', ' ¶ '), ',', ' , ')) AS x
    FROM (SELECT id, source, CASE WHEN right(t, 1) IN ('.', '…') THEN rtrim({_quoted(BLANKS)}, regexp_replace(t, {_regex(DOTS)}, '')) ELSE t END AS t
        FROM (SELECT id, source, CASE WHEN contains(t, '..') OR contains(t, '…') THEN rtrim({_quoted(BLANKS)}, regexp_replace(t, {_regex(CUT_MARK)}, '')) ELSE t END AS t
            FROM (SELECT {{id}} AS id, {{source}} AS source, rtrim({_quoted(BLANKS)}, {{text}}) AS t FROM {{rows}} WHERE {{text}} IS NOT NULL) WHERE t <> '')))"""

WORDS = "SELECT c, count(*) AS n FROM (SELECT explode(slice(w, 1, greatest(size(w) - 1, 0))) AS c FROM {texts}) GROUP BY c"
# The vocabulary, numbered; 0 is a place before the text, 1 any other word.
KNOWN = "SELECT c AS k, row_number() OVER (ORDER BY c) + 1L AS number FROM {words} WHERE n >= {least} AND n * {share} >= {total} AND NOT contains(c, '�')"

_KEY = "shiftleft(shiftleft(coalesce(ka.number, if(a = '^', 0L, 1L)), 17) | coalesce(kb.number, if(b = '^', 0L, 1L)), 17) | coalesce(kc.number, 1L) AS key"
_JOINED = " ".join(f"LEFT JOIN {{known}} k{x} ON g.{x} = k{x}.k" for x in "abc")

# Every trigram of classes that something follows, packed in one number: how often that ends the sentence.
GRAMS = f"""SELECT key, count_if(e) AS ends, count_if(NOT e) AS inside FROM
    (SELECT {_KEY}, {ENDING} AS e FROM
        (SELECT g.* FROM (SELECT explode(arrays_zip(a, b, c, d)) AS g FROM (SELECT concat(array('^', '^'), w) AS a, concat(array('^'), w) AS b, w AS c, slice(w, 2, size(w)) AS d FROM {{texts}})) WHERE g.d IS NOT NULL AND g.c <> '¶') g {_JOINED})
    GROUP BY key"""

# The trigram that ends each open text; the last word as it stands, without a broken character.
FINALS = f"""SELECT id, source, open, {_KEY}, rtrim('�', g.c) AS piece, short, whole FROM
    (SELECT id, source, open AND size(w) > 0 AS open, element_at(f, -3) AS a, element_at(f, -2) AS b, element_at(f, -1) AS c, size(w) <= 3 AS short, if(open AND size(w) <= 3, array_join(w, ' '), NULL) AS whole
        FROM (SELECT *, concat(array('^', '^', '^'), w) AS f FROM {{texts}})) g {_JOINED}"""

_WORD, _PAIR = (1 << 17) - 1, (1 << 34) - 1
STEPS = {
    "wholes": "SELECT whole, count(*) AS copies FROM {finals} WHERE whole IS NOT NULL GROUP BY whole HAVING count(*) > 1",
    "asked": f"SELECT key, key & {_WORD} = 1 AS new, piece, short, copies FROM (SELECT key, piece, short, coalesce(copies, 0) AS copies FROM {{finals}} f LEFT JOIN {{wholes}} h ON f.whole = h.whole WHERE open) GROUP BY key, piece, short, copies",
    "any3": "SELECT shiftright(key, 17) AS key, sum(ends) AS ends, sum(inside) AS inside FROM {grams} GROUP BY shiftright(key, 17)",
    "two": f"SELECT key & {_PAIR} AS key, sum(ends) AS ends, sum(inside) AS inside FROM {{grams}} GROUP BY key & {_PAIR}",
    "any2": "SELECT shiftright(key, 17) AS key, sum(ends) AS ends, sum(inside) AS inside FROM {two} GROUP BY shiftright(key, 17)",
    "one": f"SELECT key & {_WORD} AS key, sum(ends) AS ends, sum(inside) AS inside FROM {{two}} GROUP BY key & {_WORD}",
    # The words of the vocabulary that go on from each piece: asked for as trigrams and as pairs.
    "longer": "SELECT left(k, n) AS piece, number FROM (SELECT k, number, explode(sequence(1, length(k) - 1)) AS n FROM {known} WHERE length(k) > 1)",
    "longer3": "SELECT DISTINCT q.key, q.piece FROM {asked} q JOIN {longer} x ON q.piece = x.piece JOIN {grams} g ON g.key = q.key - 1 + x.number WHERE q.new",
    "longer2": f"SELECT DISTINCT q.key, q.piece FROM (SELECT DISTINCT key & {_PAIR} AS key, piece FROM {{asked}} WHERE new) q JOIN {{longer}} x ON q.piece = x.piece JOIN {{two}} t ON t.key = q.key - 1 + x.number",
    "longer1": "SELECT DISTINCT piece FROM {longer}",
}
_LAST = "CASE WHEN q.new AND l1.piece IS NOT NULL THEN 'piece1' ELSE 'none' END"  # what no count tells of


def _tells(name: str, x: str, only: str = "true") -> str:
    """Where a table's counts tell: that the text was cut, or that it wasn't."""
    places = f"coalesce({x}.ends + {x}.inside, 0) + q.copies"
    return f"{only} AND {places} >= {{least}} THEN CASE WHEN (coalesce({x}.ends, 0) + q.copies) * {{rare}} <= {places} THEN '{name}' ELSE 'none' END"


def verdict(no_word_before: str) -> str:
    """The evidence, as a CASE over the counts that were joined."""
    whens = (
        "q.new AND q.copies > 0 THEN 'none'", "q.new AND (l3.piece IS NOT NULL OR q.piece = '' AND y.ends IS NOT NULL) THEN 'piece3'", "q.new AND (l2.piece IS NOT NULL OR q.piece = '' AND z.ends IS NOT NULL) THEN 'piece2'",
        f"q.new AND {no_word_before} THEN {_LAST}", _tells("three", "g"), _tells("any3", "y", "q.new"), f"q.short THEN {_LAST}", _tells("two", "t"), _tells("any2", "z", "q.new"), _tells("one", "o", "NOT q.new"),
    )
    return "CASE " + " ".join("WHEN " + w for w in whens) + f" ELSE {_LAST} END"


VERDICTS = f"""SELECT q.key, q.piece, q.short, q.copies, {verdict(f"shiftright(q.key, 17) & {_WORD} = 0")} AS evidence FROM {{asked}} q
    LEFT JOIN {{grams}} g ON q.key = g.key LEFT JOIN {{any3}} y ON shiftright(q.key, 17) = y.key LEFT JOIN {{two}} t ON q.key & {_PAIR} = t.key
    LEFT JOIN {{any2}} z ON shiftright(q.key, 17) & {_WORD} = z.key LEFT JOIN {{one}} o ON q.key & {_WORD} = o.key
    LEFT JOIN {{longer3}} l3 ON q.key = l3.key AND q.piece = l3.piece AND q.new LEFT JOIN {{longer2}} l2 ON q.key & {_PAIR} = l2.key AND q.piece = l2.piece AND q.new
    LEFT JOIN {{longer1}} l1 ON q.piece = l1.piece AND q.new"""

CUTS = """SELECT f.id, f.source, coalesce(v.evidence, 'none') <> 'none' AS cut, coalesce(v.evidence, 'none') AS evidence FROM {finals} f LEFT JOIN {wholes} h ON f.whole = h.whole
    LEFT JOIN {verdicts} v ON f.open AND f.key = v.key AND f.piece = v.piece AND f.short = v.short AND coalesce(h.copies, 0) = v.copies"""


def truncated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", rare: int = RARE, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(id, source, cut, evidence) of every text that isn't null or blank;
    ``evidence`` is the count that told (three, any3, two, any2, one, or piece3,
    piece2 and piece1 for a piece of a longer word), "none" where it isn't cut.

    What is broadcast is the vocabulary, at most ``share`` words; everything
    else is aggregated on the map side, then joined by key."""
    spark, own = docs.sparkSession, uuid.uuid4().hex[:8]
    name = {k: f"{k}_{own}" for k in ("rows", "texts", "words", "known", "grams", "finals", *STEPS, "verdicts")}
    docs.createOrReplaceTempView(name["rows"])
    more = {"id": id_col, "text": text, "source": source, "least": least, "rare": rare, "share": share}

    def step(k: str, sql: str, write: bool = False) -> DataFrame:
        for x, v in {**name, **more}.items():
            sql = sql.replace("{" + x + "}", str(v))
        out = spark.sql(sql)
        out = common.cut(out, k) if write else out
        if k in name:
            out.createOrReplaceTempView(name[k])
        return out

    step("texts", TEXTS, True)
    more["total"] = step("words", WORDS, True).agg(F.sum("n")).first()[0] or 0
    F.broadcast(step("known", KNOWN)).createOrReplaceTempView(name["known"])
    step("grams", GRAMS, True)
    step("finals", FINALS, True)
    for k, sql in STEPS.items():
        step(k, sql, k in ("asked", "two"))
    step("verdicts", VERDICTS)
    return step("cuts", CUTS)


def rates(cuts: DataFrame) -> DataFrame:
    """How often each source truncates: documents, cut, rate."""
    return cuts.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"))
