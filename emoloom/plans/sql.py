"""Pieces of the SQL that the queries are held against."""

from __future__ import annotations

from ..functions import lexicons as L
from ..functions.text import NOT_WS, WS
from ..schema import LABELS

H, TRAIN, PRED, DOCS = "harmonized_pre_dedup", "train", "predictions", "documents"
BN = r"[\x{980}-\x{9ff}]"


def text(t: str) -> str:
    return f"coalesce({t}, '')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def tok(t: str) -> str:
    return f"list_filter(string_split({squeeze(text(t))}, ' '), lambda x: x <> '')"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]::VARCHAR[]"


def count_in(t: str, words) -> str:
    return f"len(list_filter({t}, lambda x: list_contains({array(words)}, x)))"


def matches(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def dbl(c: str) -> str:
    return f"({c})::DOUBLE"


def label_sum(labels=LABELS) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in labels)


def unpivoted(table: str, keep: str = "", labels=LABELS, expr=lambda c: c) -> str:
    """(keep…, label, y): one row a label."""
    keep = keep + ", " if keep else ""
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS label, {expr(c)} AS y FROM {table}" for c in labels)


def long_predictions(table: str = PRED, keep: str = "", labels=LABELS) -> str:
    keep = keep + ", " if keep else ""
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS label, true_{c} AS y, pred_{c} AS p, prob_{c} AS prob FROM {table}" for c in labels)


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


ENDING = NOT_WS
EMOTIONS = L.EMOTIONS
