"""Text cleaning, tokens and keys as Catalyst expressions.

Blanks are those of Unicode (``WS``), spelled out so that every engine that
reads the pattern agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .lexicons import COMPOSED

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
URL = rf"(?i)(?:https?://|ftp://|www\.){NOT_WS}+"
MENTION = rf"@{NOT_WS}+"
TAG = r"<[^>]+>"
ENTITY = r"&(?:[a-zA-Z]+|#[0-9]+);"
REPEATABLE = "?!.,;:-_।"
REPEATED = r"([?!.,;:\-_।])\1{2,}"
EMOJI_RANGE = "[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f700-\U0001f77f\U0001f780-\U0001f7ff\U0001f800-\U0001f8ff\U0001f900-\U0001f9ff\U0001fa00-\U0001fa6f\U0001fa70-\U0001faff\U00002702-\U000027b0]"


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def tokens(c: Column) -> Column:
    """The words between blanks; the empty array for null, empty and blank text."""
    return F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda x: x != "")


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def without_mentions(c: Column) -> Column:
    return F.regexp_replace(c, MENTION, " ")


def without_markup(c: Column) -> Column:
    """Tags, then entities, as spaces."""
    return F.regexp_replace(F.regexp_replace(c, TAG, " "), ENTITY, " ")


def normalised_bangla(c: Column) -> Column:
    """Two-character letters and vowel signs as one character, no zero-width
    characters; runs of blanks as one space.  Other scripts stay as they are."""
    out = F.translate(squeeze(c), "​‌⁠﻿", "")
    for two, one in COMPOSED:
        out = F.replace(out, F.lit(two), F.lit(one))
    return out


def shortened_marks(c: Column) -> Column:
    """Three or more equal marks as two."""
    return F.regexp_replace(c, REPEATED, "$1$1")


def cleaned(c: Column, empty: str = "") -> Column:
    """The cleaning chain; null, blank and emptied text give ``empty``."""
    out = without_markup(without_mentions(without_urls(F.coalesce(c, F.lit("")))))
    out = squeeze(shortened_marks(normalised_bangla(out)))
    return out if empty == "" else F.when(out == "", F.lit(empty)).otherwise(out)


@cache
def _nfc():
    # inside a function, so that workers get it by value and needn't import this package
    @F.pandas_udf(StringType())
    def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for texts in batches:
            yield texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return nfc


def nfc(c: Column) -> Column:
    """Unicode NFC, which Spark lacks; null stays null."""
    return _nfc()(c)


def comparison_key(c: Column) -> Column:
    """NFC, runs of blanks as one space, none at the ends; "" for null."""
    return squeeze(nfc(F.coalesce(c, F.lit(""))))


def simple_key(c: Column) -> Column:
    """Lower case without blanks at the ends; "" for null."""
    ends = rf"^{WS}+|{WS}+$"
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), ends, ""))


def short_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, length)


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def preserved(before: Column, after: Column, words: list[str]) -> dict[str, Column]:
    """Which listed words of a text its cleaned form kept and lost, sorted."""
    had = F.array_intersect(tokens(before), literals(words))
    kept = F.array_sort(F.array_intersect(had, tokens(after)))
    lost = F.array_sort(F.array_except(had, tokens(after)))
    return {"present": kept, "lost": lost, "all_preserved": F.size(lost) == 0}


def spot_flags(c: Column) -> dict[str, Column]:
    """What a text holds for the cleaning to act on; false for null."""
    tests = {"had_url": URL, "had_mention": MENTION, "had_astral": "[\U00010000-\U0010ffff]", "had_marks": r"[?!.,;:\-_।]{3,}", "had_html": TAG}
    return {name: F.coalesce(c.rlike(p), F.lit(False)) for name, p in tests.items()}
