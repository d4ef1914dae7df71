"""The SQL that DuckDB can run for queries of this subpackage.

Problem 10 is SQL throughout.  The others read texts by byte lattices, tries,
letter models or byte pairs (p1 to p4, p8, and p9, whose sizes are tokens), or
by keys made of such forms (p5 to p7); they are held against brute force and
plain Python in the tests.
"""

from __future__ import annotations

from . import truncation as T


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CHARS = "'" + "' || '".join(f"' || chr({ord(c)}) || '" if not c.isalnum() else c for c in T.BLANKS) + "'"
_FROM = " || ".join(f"chr({ord(c)})" for c in T.ENDS + T.OTHERS)
_TEXTS = f"""SELECT id, source, NOT (coalesce(right(regexp_replace(t, {_quoted(T.CLOSERS)}, ''), 1) IN ('।', '॥', '!', '?', '.'), false) OR regexp_matches(t, {_quoted(T.EMOJI + '$|' + T.LINKED)})) AS open,
    list_filter(string_split_regex(replace(replace(translate(lower(t), {_FROM}, '{"¶" * len(T.ENDS)}{" " * len(T.OTHERS)}'), '¶', ' ¶ '), ',', ' , '), ' +'), lambda x: x <> '') AS w
    FROM (SELECT id, source, rtrim(regexp_replace(rtrim(regexp_replace(t, {_quoted(T.CUT_MARK)}, ''), {_CHARS}), {_quoted(T.DOTS)}, ''), {_CHARS}) AS t
        FROM (SELECT doc_id AS id, source, rtrim(text, {_CHARS}) AS t FROM documents WHERE text IS NOT NULL) WHERE t <> '')"""
_TOKENS = "SELECT id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] ELSE '^' END AS b, CASE WHEN i > 2 THEN w[i - 2] ELSE '^' END AS a, w[i + 1] AS d FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM texts)"
_CLASSES = "coalesce(ka.k, CASE WHEN a = '^' THEN a ELSE '*' END) AS a, coalesce(kb.k, CASE WHEN b = '^' THEN b ELSE '*' END) AS b, coalesce(kc.k, '*') AS c"
_JOINED = " ".join(f"LEFT JOIN known k{x} ON g.{x} = k{x}.k" for x in "abc")
_STEPS = {
    "texts": _TEXTS,
    "tokens": _TOKENS,
    "known": f"SELECT c AS k FROM tokens GROUP BY c HAVING count(*) >= {T.LEAST} AND count(*) * {T.SHARE} >= (SELECT count(*) FROM tokens) AND NOT contains(c, '�')",
    "grams": f"SELECT a, b, c, count(*) FILTER (WHERE e) AS ends, count(*) FILTER (WHERE NOT e) AS inside FROM (SELECT {_CLASSES}, {T.ENDING} AS e FROM (SELECT * FROM tokens WHERE c <> '¶') g {_JOINED}) GROUP BY a, b, c",
    "finals": f"""SELECT id, source, open, {_CLASSES}, rtrim(g.c, '�') AS piece, short, whole FROM
        (SELECT id, source, open AND len(w) > 0 AS open, f[len(f) - 2] AS a, f[len(f) - 1] AS b, f[len(f)] AS c, len(w) <= 3 AS short, CASE WHEN open AND len(w) <= 3 THEN array_to_string(w, ' ') END AS whole
            FROM (SELECT *, list_concat(['^', '^', '^'], w) AS f FROM texts)) g {_JOINED}""",
    "wholes": "SELECT whole, count(*) AS copies FROM finals WHERE whole IS NOT NULL GROUP BY whole HAVING count(*) > 1",
    "asked": "SELECT DISTINCT a, b, c, c = '*' AS new, piece, short, coalesce(copies, 0) AS copies FROM finals f LEFT JOIN wholes h ON f.whole = h.whole WHERE open",
    "any3": "SELECT a, b, sum(ends) AS ends, sum(inside) AS inside FROM grams GROUP BY a, b",
    "two": "SELECT b, c, sum(ends) AS ends, sum(inside) AS inside FROM grams GROUP BY b, c",
    "any2": "SELECT b, sum(ends) AS ends, sum(inside) AS inside FROM grams GROUP BY b",
    "one": "SELECT c, sum(ends) AS ends, sum(inside) AS inside FROM grams GROUP BY c",
    "longer3": "SELECT DISTINCT g.a, g.b, left(c, n) AS piece FROM (SELECT a, b, c, unnest(range(1, length(c))) AS n FROM grams WHERE c <> '*') g JOIN (SELECT DISTINCT a, b FROM asked WHERE new) q ON g.a = q.a AND g.b = q.b",
    "longer2": "SELECT DISTINCT g.b, left(c, n) AS piece FROM (SELECT b, c, unnest(range(1, length(c))) AS n FROM two WHERE c <> '*') g JOIN (SELECT DISTINCT b FROM asked WHERE new) q ON g.b = q.b",
    "longer1": "SELECT DISTINCT left(k, n) AS piece FROM (SELECT k, unnest(range(1, length(k))) AS n FROM known)",
    "verdicts": f"""SELECT q.a, q.b, q.c, q.piece, q.short, q.copies, {T.verdict("q.b = '^'")} AS evidence FROM asked q LEFT JOIN grams g ON q.a = g.a AND q.b = g.b AND q.c = g.c
        LEFT JOIN any3 y ON q.a = y.a AND q.b = y.b LEFT JOIN two t ON q.b = t.b AND q.c = t.c LEFT JOIN any2 z ON q.b = z.b LEFT JOIN one o ON q.c = o.c
        LEFT JOIN longer3 l3 ON q.a = l3.a AND q.b = l3.b AND q.piece = l3.piece AND q.new LEFT JOIN longer2 l2 ON q.b = l2.b AND q.piece = l2.piece AND q.new LEFT JOIN longer1 l1 ON q.piece = l1.piece AND q.new""",
    "cuts": """SELECT f.id, f.source, coalesce(v.evidence, 'none') <> 'none' AS cut, coalesce(v.evidence, 'none') AS evidence FROM finals f LEFT JOIN wholes h ON f.whole = h.whole
        LEFT JOIN verdicts v ON f.open AND f.a = v.a AND f.b = v.b AND f.c = v.c AND f.piece = v.piece AND f.short = v.short AND coalesce(h.copies, 0) = v.copies""",
}


_CUTS = "WITH " + ", ".join(f"{k} AS ({sql})" for k, sql in _STEPS.items()).replace("{least}", str(T.LEAST)).replace("{rare}", str(T.RARE))


def oracle_sql() -> dict[str, str]:
    return {
        "p10_found": f"{_CUTS} SELECT id AS doc_id FROM cuts WHERE cut",
        "p10_evidence": f"{_CUTS} SELECT evidence, count(*) AS documents FROM cuts GROUP BY evidence",
        "p10_rates": f"{_CUTS} SELECT source, count(*) AS documents, count(*) FILTER (WHERE cut) AS cut, round(avg(cut::INT), 6) AS rate FROM cuts GROUP BY source",
    }
