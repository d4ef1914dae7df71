"""Per-row features: each function gives its columns by name, in order.

Null text counts as empty.  Words are those between blanks; a list's entries
of several words match only in ``negation_basic``, whose matcher is greedy.
``tok`` is a column of words: make it once (``tokens``) and pass it on.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicons as L
from .text import EMOJI_RANGE, NOT_WS, literals

EMOTIONS = ("anger", "disgust", "fear", "joy", "sadness", "surprise")
BANGLA = r"[\x{980}-\x{9ff}]"
DIGIT = r"[0-9০-৯]"
# A pictograph with its modifiers and joined parts, a flag, or a keycap is one emoji.
_PICT = r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F7E0}-\x{1F7EB}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23FA}\x{2194}-\x{21AA}\x{25AA}-\x{25FE}\x{203C}\x{2049}\x{3030}\x{303D}\x{1F004}\x{1F0CF}\x{1F18E}\x{1F191}-\x{1F19A}]"
_ONE = rf"{_PICT}\x{{FE0F}}?[\x{{1F3FB}}-\x{{1F3FF}}]?"
EMOJI = rf"(?:[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_ONE}(?:\x{{200D}}{_ONE})*)"


def _n(c: Column) -> Column:
    return c.cast("double")


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _matches(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def _count_in(tok: Column, words: list[str]) -> Column:
    """How many words are listed."""
    listed = literals(words)
    return F.size(F.filter(tok, lambda x: F.array_contains(listed, x)))


def _at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def _empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def _around(tok: Column, i: Column, reach: int = 3) -> Column:
    """The words around place ``i`` (from 0), it left out."""
    start = F.greatest(i - reach, F.lit(0))
    return F.concat(F.slice(tok, start + 1, i - start), F.slice(tok, i + 2, F.lit(reach)))


def _places(tok: Column) -> Column:
    """The places of the words, from 0."""
    return F.when(F.size(tok) > 0, F.sequence(F.lit(0), F.size(tok) - 1)).otherwise(F.array().cast("array<int>"))


def _places_in(tok: Column, words: list[str]) -> Column:
    listed = literals(words)
    return F.filter(_places(tok), lambda i: F.array_contains(listed, F.element_at(tok, i + 1)))


def emoji_list(t: Column) -> Column:
    return F.regexp_extract_all(_empty(t), F.lit(EMOJI), F.lit(0))


def emoji_base(t: Column) -> dict[str, Column]:
    found, n = emoji_list(t), F.length(_empty(t))
    kinds = F.array_distinct(found)
    repeated = F.size(F.filter(kinds, lambda e: F.size(F.filter(found, lambda x: x == e)) >= 2))
    return {
        "emoji_count": _n(F.size(found)), "emoji_unique_count": _n(F.size(kinds)), "emoji_repeated_count": _n(repeated),
        "emoji_density": F.size(found) / _at_least_one(n), "has_emoji": _flag(F.size(found) > 0),
    }


def emoji_indicators(t: Column, vocabulary: list[str]) -> dict[str, Column]:
    """One column for each emoji of a fitted vocabulary."""
    found = emoji_list(t)
    return {f"emoji_{k}": _flag(F.array_contains(found, e)) for k, e in enumerate(vocabulary)}


def expressive(t: Column, tok: Column) -> dict[str, Column]:
    t = _empty(t)
    n, words = F.length(t), F.size(tok)
    elongated = F.size(F.filter(tok, lambda w: w.rlike(r"([^\n])\1{2,}")))
    caps = F.size(F.filter(tok, lambda w: (F.upper(w) == w) & (F.lower(w) != w)))
    letters = F.aggregate(tok, F.lit(0), lambda a, w: a + F.length(w))
    return {
        "expr_exclamation_count": _n(_matches(t, "!")), "expr_question_count": _n(_matches(t, r"\?")),
        "expr_repeated_excl_count": _n(_matches(t, "!{3,}")), "expr_repeated_ques_count": _n(_matches(t, r"\?{3,}")),
        "expr_repeated_punct_count": _n(_matches(t, r"([?!.,;:\-_।])\1{2,}")), "expr_elongated_word_count": _n(elongated),
        "expr_char_count": _n(n), "expr_word_count": _n(words), "expr_avg_word_len": F.when(words > 0, letters / words).otherwise(0.0),
        "expr_uppercase_ratio": _matches(t, r"\p{Lu}") / _at_least_one(n), "expr_digit_count": _n(_matches(t, r"[\p{Nd}]")),
        "expr_bangla_char_ratio": _matches(t, BANGLA) / _at_least_one(n), "expr_all_caps_word_count": _n(caps),
    }


def greedy_count(tok: Column, entries: list[str]) -> Column:
    """Matches of entries of one to three words from the left, the longest
    first, none overlapping: a fold over the places."""
    listed, first = literals(entries), literals(list(dict.fromkeys(e.split(" ")[0] for e in entries)))

    def width(x: Column, i: Column) -> Column:
        """The longest entry that starts at a place; only where its first word is one's."""
        three, two = (F.array_contains(listed, F.array_join(F.slice(tok, i + 1, F.lit(k)), " ")) & (i + k <= F.size(tok)) for k in (3, 2))
        return F.when(~F.array_contains(first, x), 0).when(three, 3).when(two, 2).when(F.array_contains(listed, x), 1).otherwise(0)

    def step(state: Column, w: Column) -> Column:
        hit = (state["busy"] <= 0) & (w > 0)
        return F.struct(F.when(hit, w - 1).otherwise(state["busy"] - 1).alias("busy"), (state["n"] + hit.cast("int")).alias("n"))

    start = F.struct(F.lit(0).alias("busy"), F.lit(0).alias("n"))
    fold = F.aggregate(F.transform(tok, width), start, step, lambda s: s["n"])
    return F.when(F.arrays_overlap(tok, first), fold).otherwise(0)


def negation_basic(
    tok: Column, negations: list[str] = L.NEGATIONS, intensifiers: list[str] = L.INTENSIFIERS, diminishers: list[str] = L.DIMINISHERS, verbs: list[str] = L.VERBS
) -> dict[str, Column]:
    neg, ints, dims = (greedy_count(tok, x) for x in (negations, intensifiers, diminishers))
    places = _places_in(tok, negations)
    before = F.size(F.filter(places, lambda i: F.arrays_overlap(F.slice(tok, i + 2, F.lit(3)), literals(verbs))))
    near = F.size(F.filter(places, lambda i: F.arrays_overlap(_around(tok, i), literals(intensifiers))))
    total = neg + ints + dims
    return {
        "neg_count": _n(neg), "neg_present": _flag(neg > 0), "intensifier_count": _n(ints), "intensifier_present": _flag(ints > 0),
        "diminisher_count": _n(dims), "diminisher_present": _flag(dims > 0), "neg_before_verb_count": _n(before),
        "neg_intensified_count": _n(near), "total_modifier_count": _n(total), "modifier_ratio": total / _at_least_one(F.size(tok)),
    }


def sentiment(tok: Column, positive: list[str] = L.POSITIVE, negative: list[str] = L.NEGATIVE) -> dict[str, Column]:
    pos, neg, n = _count_in(tok, positive), _count_in(tok, negative), _at_least_one(F.size(tok))
    net = pos - neg
    return {
        "sent_pos": _n(pos), "sent_neg": _n(neg), "sent_net": _n(net), "sent_pos_ratio": pos / n, "sent_neg_ratio": neg / n,
        "sent_abs": _n(F.abs(net)), "sent_sign": F.signum(net), "sent_has_pos": _flag(pos > 0), "sent_has_neg": _flag(neg > 0),
        "sent_mixed": _flag((pos > 0) & (neg > 0)),
    }


def emotion_lexicon(tok: Column, emotions: dict[str, list[str]] = L.EMOTIONS) -> dict[str, Column]:
    n = _at_least_one(F.size(tok))
    counts = {e: _count_in(tok, emotions[e]) for e in EMOTIONS}
    return (
        {f"lex_{e}": _n(c) for e, c in counts.items()}
        | {f"lex_{e}_ratio": c / n for e, c in counts.items()}
        | {f"lex_{e}_present": _flag(c > 0) for e, c in counts.items()}
    )


def negation_scope(
    tok: Column, negations: list[str] = L.NEGATIONS, intensifiers: list[str] = L.INTENSIFIERS, emotions: dict[str, list[str]] = L.EMOTIONS
) -> dict[str, Column]:
    """An emotion word near two negations counts twice; a negation's own place doesn't count."""
    n = _at_least_one(F.size(tok))
    neg, ints, places = _count_in(tok, negations), _count_in(tok, intensifiers), _places_in(tok, negations)
    near = F.size(F.filter(places, lambda i: F.arrays_overlap(_around(tok, i), literals(intensifiers))))
    windows = F.flatten(F.transform(places, lambda i: _around(tok, i)))
    scope = {e: _count_in(windows, emotions[e]) for e in EMOTIONS}
    total = sum(scope.values(), F.lit(0))
    return (
        {"scope_neg": _n(neg), "scope_neg_present": _flag(neg > 0), "scope_int": _n(ints), "scope_int_present": _flag(ints > 0), "scope_neg_int": _n(near), "scope_total": _n(total)}
        | {f"scope_{e}": _n(c) for e, c in scope.items()}
        | {"scope_neg_ratio": neg / n, "scope_int_ratio": ints / n, "scope_total_ratio": total / n, "scope_neg_int_ratio": (neg + ints) / n}
    )


def elongation(t: Column, tok: Column) -> dict[str, Column]:
    words = F.size(F.filter(tok, lambda w: w.rlike(r"([^\n])\1{2,}")))
    return {
        "elong_words": _n(words), "elong_present": _flag(words > 0), "elong_runs": _n(_matches(_empty(t), r"([^\n])\1{2,}")),
        "elong_ratio": words / _at_least_one(F.size(tok)),
    }


def hashtags(t: Column) -> dict[str, Column]:
    t = _empty(t)
    tags = F.regexp_extract_all(t, F.lit(f"#{NOT_WS}+"), F.lit(0))
    letters = F.aggregate(tags, F.lit(0), lambda a, x: a + F.length(x))
    return {"hashtag_count": _n(F.size(tags)), "hashtag_present": _flag(F.size(tags) > 0), "hashtag_char_ratio": letters / _at_least_one(F.length(t))}


def code_mix(t: Column) -> dict[str, Column]:
    t = _empty(t)
    n, bangla, latin = _at_least_one(F.length(t)), _matches(t, BANGLA), _matches(t, "[a-zA-Z]")
    return {"mix_bangla": bangla / n, "mix_latin": latin / n, "mix_digit": _matches(t, r"[\p{Nd}]") / n, "mix_mixed": _flag((bangla >= 3) & (latin >= 3))}


def text_stats(t: Column, tok: Column) -> dict[str, Column]:
    n, words = F.length(_empty(t)), F.size(tok)
    return {
        "stat_ttr": F.size(F.array_distinct(tok)) / _at_least_one(words), "stat_word_len": n / _at_least_one(words) / 15.0,
        "stat_log_chars": F.log1p(n) / 10.0, "stat_log_words": F.log1p(words) / 6.0,
    }


def divergence(raw: Column, clean: Column) -> dict[str, Column]:
    """How many words two token columns differ by, place by place."""
    both = F.least(F.size(raw), F.size(clean))
    differ = F.size(F.filter(F.zip_with(F.slice(raw, F.lit(1), both), F.slice(clean, F.lit(1), both), lambda a, b: a != b), lambda x: x))
    differ = differ + F.abs(F.size(raw) - F.size(clean))
    return {"div_count": _n(differ), "div_present": _flag(differ > 0), "div_ratio": differ / _at_least_one(F.size(raw))}


def verb_endings(t: Column, tok: Column, past: list[str] = L.PAST, present: list[str] = L.PRESENT, future: list[str] = L.FUTURE) -> dict[str, Column]:
    r"""Matches of \b\S+(ending)\b; a vowel sign is no word character there, so
    an ending in one needs a word character behind it."""
    t, n = _empty(t), _at_least_one(F.size(tok))
    word = r"[\p{L}\p{N}_]"
    edge = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    a, b, c = (_matches(t, rf"{edge}{NOT_WS}+(?:{'|'.join(x)}){edge}") for x in (past, present, future))
    return {"verb_past": a / n, "verb_present": b / n, "verb_future": c / n, "verb_any": _flag(a + b + c > 0)}


def questions(t: Column, tok: Column, words: list[str] = L.QUESTION_WORDS) -> dict[str, Column]:
    t = _empty(t)
    wh, marks = _count_in(tok, words), _matches(t, r"\?+")
    return {
        "q_words": _n(wh), "q_word_present": _flag(wh > 0), "q_mark_rate": marks / _at_least_one(F.length(t)) * 10, "q_mark_present": _flag(marks > 0),
        "q_exclamation": _flag(t.contains("!")), "q_cluster": _flag(t.rlike("[?!]{2,}")), "q_triple": _flag(t.rlike(r"\?{2,}")), "q_ellipsis": _flag(t.rlike(r"\.{3,}|…")),
    }


def contrast(tok: Column, connectives: list[str] = L.CONNECTIVES, emotions: dict[str, list[str]] = L.EMOTIONS) -> dict[str, Column]:
    """What stands before and behind the first connective; nothing where it is the last word."""
    negative = list(dict.fromkeys(w for e in ("disgust", "anger", "fear", "sadness") for w in emotions[e]))
    found = _count_in(tok, connectives)
    at = F.element_at(F.concat(_places_in(tok, connectives), F.array(F.lit(-1))), 1)
    has = (at >= 0) & (at + 1 < F.size(tok))
    first = F.when(has, F.slice(tok, F.lit(1), F.greatest(at, F.lit(0)))).otherwise(literals([]))
    second = F.when(has, F.slice(tok, at + 2, F.size(tok))).otherwise(literals([]))

    def inside(clause: Column, words: list[str]) -> Column:
        return F.arrays_overlap(clause, literals(words))

    return {
        "con_count": _n(found), "con_present": _flag(found > 0), "con_neg_second": _flag(inside(second, negative)),
        "con_pos_neg": _flag(inside(first, emotions["joy"]) & inside(second, negative)),
        "con_disgust_second": _flag(inside(second, emotions["disgust"])), "con_anger_second": _flag(inside(second, emotions["anger"])),
        "con_sadness_second": _flag(inside(second, emotions["sadness"])), "con_disgust_total": _n(_count_in(tok, emotions["disgust"])),
        "con_negative_total": _n(_count_in(tok, negative)), "con_ratio": found / _at_least_one(F.size(tok)),
    }


def intensified(tok: Column, intensifiers: list[str] = L.INTENSIFIERS, emotions: dict[str, list[str]] = L.EMOTIONS) -> dict[str, Column]:
    """Emotion words one or two places behind an intensifier."""
    behind = F.flatten(F.transform(_places_in(tok, intensifiers), lambda i: F.slice(tok, i + 2, F.lit(2))))
    counts = {e: _count_in(behind, emotions[e]) for e in EMOTIONS}
    return {f"int_{e}": _n(c) for e, c in counts.items()} | {f"int_{e}_present": _flag(c > 0) for e, c in counts.items()}


def error_patterns(raw: Column, clean: Column, tok: Column, negations: list[str] = L.NEGATIONS) -> dict[str, Column]:
    """Flags of a text; negation here is a matter of substrings, not words."""
    raw, clean = _empty(raw), _empty(clean)
    negation = F.lit(False)
    for w in negations:
        negation = negation | clean.contains(w)
    return {
        "short_text": F.size(tok) < 5, "has_negation": negation, "has_emoji_char": raw.rlike(EMOJI_RANGE), "has_hashtag": raw.rlike(f"#{NOT_WS}+"),
        "code_mixed": (_matches(raw, BANGLA) >= 3) & (_matches(raw, "[a-zA-Z]") >= 3),
    }


def log_scaled(columns: dict[str, Column]) -> dict[str, Column]:
    return {k: F.log1p(c) for k, c in columns.items()}


#: The expressive features that the selective variant keeps.
SELECTED = (0, 1, 2, 3, 4, 5, 9, 11, 12)
