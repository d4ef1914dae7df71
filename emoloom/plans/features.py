"""Features and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import features as X, text as T
from ..functions import lexicons as L
from ..operators import audit, compose, tfidf
from ..schema import LABELS
from ..session import read, spread
from . import sql as S
from .registry import query

EMO = X.EMOTIONS


def _train(spark, d) -> DataFrame:
    """Training rows with their words."""
    rows = spread(read(spark, d, "train").select("sample_id", "text", "processed_text", *LABELS))
    return rows.withColumns({"tok": T.tokens(F.col("processed_text")), "raw_tok": T.tokens(F.col("text"))})


def _rounded(columns: dict) -> list:
    return [F.round(c.cast("double"), 6).alias(k) for k, c in columns.items()]


# The words are made once, in a step of their own.
_T = f"WITH t AS (SELECT sample_id, {S.text('text')} AS text, processed_text, {S.tok('processed_text')} AS tok, {S.tok('text')} AS raw_tok, {', '.join(LABELS)} FROM train), u AS (SELECT *, length(text) AS n_chars, greatest(length(text), 1) AS nc, len(tok) AS n_tok, greatest(len(tok), 1) AS n, greatest(len(raw_tok), 1) AS rn FROM t)"


def _select(columns: dict[str, str], rest: str = "") -> str:
    return f"{_T}{rest} SELECT sample_id, " + ", ".join(f"round(({c})::DOUBLE, 6) AS {k}" for k, c in columns.items()) + " FROM u"


def _has(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


_CHARS = "list_filter(range(1, len({w}) - 1), lambda i: {w}[i] = {w}[i + 1] AND {w}[i + 1] = {w}[i + 2])"
_LONG = "len(list_filter(raw_tok, lambda w: len(" + _CHARS.format(w="w") + ") > 0))"


def _runs(t: str, only: str = "") -> str:
    """Maximal runs of three equal characters or more."""
    keep = f" AND strpos('{only}', {t}[i]) > 0" if only else f" AND {t}[i] <> chr(10)"
    return f"len(list_filter(range(1, length({t}) - 1), lambda i: {t}[i] = {t}[i + 1] AND {t}[i + 1] = {t}[i + 2] AND (i = 1 OR {t}[i - 1] <> {t}[i]){keep}))"


_EXPR = {
    "expr_exclamation_count": S.matches("text", "!"), "expr_question_count": S.matches("text", r"\?"), "expr_repeated_excl_count": S.matches("text", "!{3,}"), "expr_repeated_ques_count": S.matches("text", r"\?{3,}"),
    "expr_repeated_punct_count": _runs("text", T.REPEATABLE), "expr_elongated_word_count": _LONG, "expr_char_count": "n_chars", "expr_word_count": "len(raw_tok)",
    "expr_avg_word_len": "CASE WHEN len(raw_tok) > 0 THEN list_sum(list_transform(raw_tok, lambda w: length(w))) / len(raw_tok) ELSE 0 END", "expr_uppercase_ratio": S.matches("text", r"\p{Lu}") + " / nc",
    "expr_digit_count": S.matches("text", r"[\p{Nd}]"), "expr_bangla_char_ratio": S.matches("text", S.BN) + " / nc", "expr_all_caps_word_count": "len(list_filter(raw_tok, lambda w: upper(w) = w AND lower(w) <> w))",
}


@query(_select(_EXPR))
def feat_expressive(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.expressive(F.col("text"), F.col("raw_tok"))))


_P, _N = S.count_in("tok", L.lexicon(L.POSITIVE)), S.count_in("tok", L.lexicon(L.NEGATIVE))


@query(f"{_T}, c AS (SELECT sample_id, n, {_P} AS p, {_N} AS g FROM u) SELECT sample_id, p::DOUBLE AS sent_pos, g::DOUBLE AS sent_neg, (p - g)::DOUBLE AS sent_net, round(p / n, 6) AS sent_pos_ratio, round(g / n, 6) AS sent_neg_ratio, abs(p - g)::DOUBLE AS sent_abs, sign(p - g)::DOUBLE AS sent_sign, {S.flag('p > 0')} AS sent_has_pos, {S.flag('g > 0')} AS sent_has_neg, {S.flag('p > 0 AND g > 0')} AS sent_mixed FROM c")
def feat_sentiment(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.sentiment(F.col("tok"))))


_COUNT = {e: S.count_in("tok", L.EMOTIONS[e]) for e in EMO}


@query(_select({f"lex_{e}": c for e, c in _COUNT.items()} | {f"lex_{e}_ratio": f"{c} / n" for e, c in _COUNT.items()} | {f"lex_{e}_present": _has(f"{c} > 0") for e, c in _COUNT.items()}))
def feat_lexicon(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.emotion_lexicon(F.col("tok"))))


def _at(words) -> str:
    return f"list_filter(range(1, len(tok) + 1), lambda i: list_contains({S.array(words)}, tok[i]))"


_AROUND = "list_concat(tok[greatest(i - 3, 1):i - 1], tok[i + 1:i + 3])"


def _greedy(words, longest: int = 3) -> str:
    """Greedy matches as a fold: the state is (first free place, count) in one number."""
    hit = "CASE " + " ".join(f"WHEN i + {k - 1} <= len(tok) AND list_contains({S.array(words)}, array_to_string(tok[i:i + {k - 1}], ' ')) THEN {k}" for k in range(longest, 0, -1)) + " ELSE 0 END"
    step = f"CASE WHEN s // 100000 <= i AND {hit} > 0 THEN (i + {hit}) * 100000 + s % 100000 + 1 ELSE s END"
    return f"(list_reduce(list_prepend(0::BIGINT, range(1, len(tok) + 1)), lambda s, i: {step}) % 100000)"


_NEGS, _INTS = L.lexicon(L.NEGATIONS), L.lexicon(L.INTENSIFIERS)
_NEAR = f"len(list_filter({_at(_NEGS)}, lambda i: list_has_any({_AROUND}, {S.array(_INTS)})))"


@query(f"{_T}, c AS (SELECT sample_id, n, {_greedy(_NEGS)} AS a, {_greedy(_INTS)} AS b, {_greedy(L.DIMINISHERS)} AS c, len(list_filter({_at(_NEGS)}, lambda i: list_has_any(tok[i + 1:i + 3], {S.array(L.VERBS)}))) AS v, {_NEAR} AS near FROM u)"
       f" SELECT sample_id, a::DOUBLE AS neg_count, {S.flag('a > 0')} AS neg_present, b::DOUBLE AS intensifier_count, {S.flag('b > 0')} AS intensifier_present, c::DOUBLE AS diminisher_count, {S.flag('c > 0')} AS diminisher_present, v::DOUBLE AS neg_before_verb_count, near::DOUBLE AS neg_intensified_count, (a + b + c)::DOUBLE AS total_modifier_count, round((a + b + c) / n, 6) AS modifier_ratio FROM c")
def feat_neg_basic(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.negation_basic(F.col("tok"))))


_WINDOWS = f"flatten(list_transform({_at(_NEGS)}, lambda i: {_AROUND}))"
_SCOPE = {e: f"len(list_filter(w, lambda x: list_contains({S.array(L.EMOTIONS[e])}, x)))" for e in EMO}


@query(f"{_T}, c AS (SELECT sample_id, n, {S.count_in('tok', _NEGS)} AS a, {S.count_in('tok', _INTS)} AS b, {_NEAR} AS near, {_WINDOWS} AS w FROM u), s AS (SELECT *, {', '.join(f'{c} AS {e}' for e, c in _SCOPE.items())} FROM c), z AS (SELECT *, {' + '.join(EMO)} AS total FROM s)"
       f" SELECT sample_id, a::DOUBLE AS scope_neg, {S.flag('a > 0')} AS scope_neg_present, b::DOUBLE AS scope_int, {S.flag('b > 0')} AS scope_int_present, near::DOUBLE AS scope_neg_int, total::DOUBLE AS scope_total, {', '.join(f'{e}::DOUBLE AS scope_{e}' for e in EMO)}, round(a / n, 6) AS scope_neg_ratio, round(b / n, 6) AS scope_int_ratio, round(total / n, 6) AS scope_total_ratio, round((a + b) / n, 6) AS scope_neg_int_ratio FROM z")
def feat_neg_scope(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.negation_scope(F.col("tok"))))


@query(_select({"elong_words": _LONG, "elong_present": _has(f"{_LONG} > 0"), "elong_runs": _runs("text"), "elong_ratio": f"{_LONG} / rn"}))
def feat_elongation(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.elongation(F.col("text"), F.col("raw_tok"))))


_TAGS = f"regexp_extract_all(text, '#{T.NOT_WS}+')"


@query(_select({"hashtag_count": f"len({_TAGS})", "hashtag_present": _has(f"len({_TAGS}) > 0"), "hashtag_char_ratio": f"coalesce(list_sum(list_transform({_TAGS}, lambda x: length(x))), 0) / nc"}))
def feat_hashtag(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.hashtags(F.col("text"))))


_B, _LAT = S.matches("text", S.BN), S.matches("text", "[a-zA-Z]")


@query(_select({"mix_bangla": f"{_B} / nc", "mix_latin": f"{_LAT} / nc", "mix_digit": S.matches("text", r"[\p{Nd}]") + " / nc", "mix_mixed": _has(f"{_B} >= 3 AND {_LAT} >= 3")}))
def feat_codemix(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.code_mix(F.col("text"))))


@query(_select({"stat_ttr": "len(list_distinct(raw_tok)) / rn", "stat_word_len": "n_chars / rn / 15.0", "stat_log_chars": "ln(1 + n_chars) / 10.0", "stat_log_words": "ln(1 + len(raw_tok)) / 6.0"}))
def feat_textstats(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.text_stats(F.col("text"), F.col("raw_tok"))))


_DIV = "len(list_filter(range(1, least(len(raw_tok), len(tok)) + 1), lambda i: raw_tok[i] <> tok[i])) + abs(len(raw_tok) - len(tok))"


@query(_select({"div_count": _DIV, "div_present": _has(f"{_DIV} > 0"), "div_ratio": f"({_DIV}) / rn"}))
def feat_divergence(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.divergence(F.col("raw_tok"), F.col("tok"))))


@query()  # its edges look around, which the other engine's patterns can't; held against Python in the tests
def feat_suffix(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.verb_endings(F.col("processed_text"), F.col("tok"))))


_WH, _Q = S.count_in("raw_tok", L.QUESTION_WORDS), S.matches("text", r"\?+")


@query(_select({"q_words": _WH, "q_word_present": _has(f"{_WH} > 0"), "q_mark_rate": f"{_Q} / nc * 10", "q_mark_present": _has(f"{_Q} > 0"), "q_exclamation": _has("contains(text, '!')"),
                "q_cluster": _has("regexp_matches(text, '[?!]{2,}')"), "q_triple": _has(r"regexp_matches(text, '\?{2,}')"), "q_ellipsis": _has(r"regexp_matches(text, '\.{3,}|…')")}))
def feat_question(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.questions(F.col("text"), F.col("raw_tok"))))


_BAD = list(dict.fromkeys(w for e in ("disgust", "anger", "fear", "sadness") for w in L.EMOTIONS[e]))


def _in(clause: str, words) -> str:
    return _has(f"list_has_any({clause}, {S.array(words)})")


@query(f"{_T}, c AS (SELECT *, {S.count_in('tok', L.CONNECTIVES)} AS cc, coalesce({_at(L.CONNECTIVES)}[1], 0) AS p FROM u), z AS (SELECT *, CASE WHEN p > 0 AND p < len(tok) THEN tok[1:p - 1] ELSE []::VARCHAR[] END AS first, CASE WHEN p > 0 AND p < len(tok) THEN tok[p + 1:] ELSE []::VARCHAR[] END AS second FROM c)"
       f" SELECT sample_id, cc::DOUBLE AS con_count, ({_has('cc > 0')})::DOUBLE AS con_present, ({_in('second', _BAD)})::DOUBLE AS con_neg_second, (CASE WHEN list_has_any(first, {S.array(L.EMOTIONS['joy'])}) AND list_has_any(second, {S.array(_BAD)}) THEN 1.0 ELSE 0.0 END)::DOUBLE AS con_pos_neg,"
       f" ({_in('second', L.EMOTIONS['disgust'])})::DOUBLE AS con_disgust_second, ({_in('second', L.EMOTIONS['anger'])})::DOUBLE AS con_anger_second, ({_in('second', L.EMOTIONS['sadness'])})::DOUBLE AS con_sadness_second, ({S.count_in('tok', L.EMOTIONS['disgust'])})::DOUBLE AS con_disgust_total, ({S.count_in('tok', _BAD)})::DOUBLE AS con_negative_total, round(cc / n, 6) AS con_ratio FROM z")
def feat_contrast(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.contrast(F.col("tok"))))


_BEHIND = f"flatten(list_transform({_at(_INTS)}, lambda i: tok[i + 1:i + 2]))"
_IC = {e: f"len(list_filter(w, lambda x: list_contains({S.array(L.EMOTIONS[e])}, x)))" for e in EMO}


@query(f"{_T}, c AS (SELECT sample_id, {_BEHIND} AS w FROM u) SELECT sample_id, " + ", ".join(f"({c})::DOUBLE AS int_{e}, ({_has(c + ' > 0')})::DOUBLE AS int_{e}_present" for e, c in _IC.items()) + " FROM c")
def feat_intens_bigram(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.intensified(F.col("tok"))))


@query(f"{_T} SELECT sample_id, len(raw_tok) < 5 AS short_text, {' OR '.join(f'contains(processed_text, {S.quoted(w)})' for w in _NEGS)} AS has_negation, regexp_matches(text, '{T.EMOJI_RANGE}') AS has_emoji_char, regexp_matches(text, '#{T.NOT_WS}+') AS has_hashtag, {_B} >= 3 AND {_LAT} >= 3 AS code_mixed FROM u")
def feat_error_patterns(spark, d):
    return _train(spark, d).select("sample_id", *(c.alias(k) for k, c in X.error_patterns(F.col("text"), F.col("processed_text"), F.col("raw_tok")).items()))


_E = f"regexp_extract_all(text, '{X.EMOJI}')"


@query(f"{_T}, c AS (SELECT sample_id, nc, {_E} AS e FROM u) SELECT sample_id, len(e)::DOUBLE AS emoji_count, len(list_distinct(e))::DOUBLE AS emoji_unique_count, len(list_filter(list_distinct(e), lambda k: len(list_filter(e, lambda x: x = k)) >= 2))::DOUBLE AS emoji_repeated_count, round(len(e) / nc, 6) AS emoji_density, {S.flag('len(e) > 0')} AS has_emoji FROM c")
def feat_emoji(spark, d):
    return _train(spark, d).select("sample_id", *_rounded(X.emoji_base(F.col("text"))))


@query(f"{_T}, e AS (SELECT unnest(list_distinct({_E})) AS emoji FROM u) SELECT emoji, count(*) AS texts FROM e GROUP BY emoji HAVING count(*) >= 10")
def emoji_vocabulary(spark, d):
    rows = _train(spark, d).select(F.explode(F.array_distinct(X.emoji_list(F.col("text")))).alias("emoji"))
    return rows.groupBy("emoji").agg(F.count("*").alias("texts")).where("texts >= 10")


@query()
def feat_emoji_indicators(spark, d):
    rows = _train(spark, d)
    return rows.select("sample_id", *_rounded(X.emoji_indicators(F.col("text"), compose.emoji_vocabulary(rows, "text"))))


_LISTS = {"negative": L.lexicon(L.NEGATIVE), "positive": L.lexicon(L.POSITIVE), "negations": _NEGS, "intensifiers": _INTS}


@query(f"{_T}, m AS ({' UNION ALL '.join(f'SELECT {S.quoted(k)} AS list, len(tok) AS s, {S.count_in(chr(116) + chr(111) + chr(107), w)} AS m FROM u' for k, w in _LISTS.items())}) SELECT list, sum(s)::BIGINT AS tokens, sum(m)::BIGINT AS matched, count_if(m > 0) AS texts, round(100 * sum(m) / greatest(sum(s), 1), 4) AS pct FROM m GROUP BY list")
def lexicon_coverage(spark, d):
    return audit.lexicon_coverage(read(spark, d, "train"), T.tokens(F.col("processed_text")), _LISTS)


@query(f"{_T}, m AS ({' UNION ALL '.join(f'SELECT {S.quoted(e)} AS label, list_has_any(tok, {S.array(L.EMOTIONS[e])}) AS hit, {e} AS y FROM u' for e in EMO)}) SELECT label, count_if(hit) AS texts, count_if(hit AND y = 1) AS texts_in_class, count_if(y = 1) AS class_size FROM m GROUP BY label")
def emotion_coverage(spark, d):
    return audit.class_coverage(read(spark, d, "train"), T.tokens(F.col("processed_text")), L.EMOTIONS)


@query(f"{_T}, c AS (SELECT {S.count_in('tok', _NEGS)} AS a, {S.count_in('tok', _INTS)} AS b, {_WINDOWS} AS w FROM u) SELECT count_if(a > 0) AS negated_texts, count_if(b > 0) AS intensified_texts, count_if({' + '.join(_SCOPE.values())} > 0) AS scoped_texts FROM c")
def scope_coverage(spark, d):
    rows = _train(spark, d).select(*(c.alias(k) for k, c in X.negation_scope(F.col("tok")).items()))
    return rows.agg(F.count_if(F.col("scope_neg") > 0).alias("negated_texts"), F.count_if(F.col("scope_int") > 0).alias("intensified_texts"), F.count_if(F.col("scope_total") > 0).alias("scoped_texts"))


_PROFILED = list(_EXPR)
_WIDE = f"{_T}, f AS (SELECT sample_id, " + ", ".join(f"({_EXPR[k]})::DOUBLE AS {k}" for k in _PROFILED) + " FROM u)"


def _profiled(spark, d) -> DataFrame:
    columns = X.expressive(F.col("text"), F.col("raw_tok"))
    return _train(spark, d).select("sample_id", *(columns[k].cast("double").alias(k) for k in _PROFILED))


@query(f"{_WIDE}, l AS ({' UNION ALL '.join(f'SELECT {S.quoted(k)} AS feature, {k} AS x FROM f' for k in _PROFILED)}) SELECT feature, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(100 * count_if(x = 0) / count(*), 4) AS pct_zero, count_if(x IS NULL OR isnan(x) OR isinf(x)) AS bad FROM l GROUP BY feature")
def feature_profile(spark, d):
    return audit.feature_profile(_profiled(spark, d), _PROFILED)


@query(f"{_WIDE}, m AS (SELECT {', '.join(f'max(abs({k})) AS {k}' for k in _PROFILED)} FROM f) SELECT sample_id, {', '.join(f'round(f.{k} / CASE WHEN m.{k} = 0 THEN 1 ELSE m.{k} END, 6) AS {k}' for k in _PROFILED)} FROM f, m")
def maxabs_scaled(spark, d):
    return compose.max_abs(_profiled(spark, d), _PROFILED).select("sample_id", *(F.round(k, 6).alias(k) for k in _PROFILED))


@query(f"{_WIDE} SELECT sample_id, {', '.join(f'round(ln(1 + {k}), 6) AS {k}' for k in _PROFILED)} FROM f")
def log_scaled(spark, d):
    return _profiled(spark, d).select("sample_id", *(F.round(F.log1p(k), 6).alias(k) for k in _PROFILED))


# -- TF-IDF -------------------------------------------------------------------------------

_WORDS = f"{S.tok('lower(processed_text)')}"
_WG = f"w AS (SELECT sample_id AS doc, {_WORDS} AS tok FROM train), terms AS (SELECT doc, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS term FROM w)"
_WINDOW = "list_transform(range(1, greatest(length(x) - {n} + 2, 2)), lambda i: x[i:i + {n} - 1])"
_CW = "CASE WHEN length(x) > 5 THEN list_concat(list_concat({a}, {b}), {c}) WHEN length(x) = 5 THEN list_concat(list_concat({a}, {b}), [x]) WHEN length(x) = 4 THEN list_concat({a}, [x]) ELSE [x] END".format(a=_WINDOW.format(n=3), b=_WINDOW.format(n=4), c=_WINDOW.format(n=5))
_CG = f"w AS (SELECT sample_id AS doc, {_WORDS} AS tok FROM train), terms AS (SELECT doc, unnest(flatten(list_transform(list_transform(tok, lambda t: ' ' || t || ' '), lambda x: {_CW}))) AS term FROM w)"
_COUNTS = "counts AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY doc, term), stats AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM counts GROUP BY term)"


def _weights(limit: int) -> str:
    return f"""{_COUNTS}, vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT * FROM stats ORDER BY tf DESC, term LIMIT {limit})),
    n AS (SELECT count(*) AS n FROM train), raw AS (SELECT doc, idx, term, (1 + ln(counts.tf)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM counts JOIN vocab USING (term), n),
    weighted AS (SELECT doc, idx, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc)) AS value FROM raw)"""


def _texts(spark, d) -> DataFrame:
    return spread(read(spark, d, "train").select("sample_id", "processed_text"))


def _weighed(spark, d, **blocks) -> DataFrame:
    out = tfidf.TfIdf(**blocks).fit_transform(_texts(spark, d), "sample_id", "processed_text")
    return out.select("doc", F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"))


@query(f"WITH {_WG}, {_weights(10_000)} SELECT doc, idx, round(value, 6) AS value FROM weighted")
def tfidf_word(spark, d):
    return _weighed(spark, d, char=None)


@query(f"WITH {_CG}, {_weights(15_000)} SELECT doc, idx, round(value, 6) AS value FROM weighted")
def tfidf_char_wb(spark, d):
    return _weighed(spark, d, word=None)


@query(f"WITH {_WG}, {_weights(10_000)} SELECT term, idx, tf, df FROM vocab")
def tfidf_vocab(spark, d):
    return tfidf.vocabulary(_texts(spark, d), "sample_id", "processed_text", "word", 10_000).select("term", F.col("idx").cast("long").alias("idx"), "tf", "df")


@query(f"WITH {_CG}, {_weights(15_000)} SELECT term, idx, tf, df FROM vocab")
def tfidf_char_vocab(spark, d):
    return tfidf.vocabulary(_texts(spark, d), "sample_id", "processed_text", "char", 15_000).select("term", F.col("idx").cast("long").alias("idx"), "tf", "df")


@query(f"WITH {_WG}, {_weights(10_000)} SELECT term, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM vocab, n")
def tfidf_idf(spark, d):
    vocab = tfidf.vocabulary(_texts(spark, d), "sample_id", "processed_text", "word", 10_000)
    return vocab.select("term", F.round(tfidf.idf(read(spark, d, "train").count(), F.col("df")), 6).alias("idf"))


@query(f"WITH {_WG}, {_COUNTS} SELECT term, tf FROM stats ORDER BY tf DESC, term LIMIT 50")
def tfidf_top_terms(spark, d):
    return tfidf.vocabulary(_texts(spark, d), "sample_id", "processed_text", "word", 50).select("term", "tf")


@query(f"WITH {_WG}, {_weights(10_000)}, z AS (SELECT count(*) AS nnz FROM weighted), w10 AS (SELECT count(*) AS width FROM vocab) SELECT round(1 - nnz / (n * width)::DOUBLE, 6) AS sparsity FROM z, n, w10")
def tfidf_sparsity(spark, d):
    x = tfidf.TfIdf(char=None).fit(_texts(spark, d), "sample_id", "processed_text")
    return tfidf.sparsity(x.transform(_texts(spark, d), "sample_id", "processed_text"), *x.shape())


@query(f"WITH {_WG}, {_weights(10_000)}, a AS (SELECT doc, idx, value FROM weighted WHERE idx < 100) SELECT doc, idx, round(value, 6) AS value FROM a")
def tfidf_slice(spark, d):
    return tfidf_word(spark, d).where("idx < 100")


_BOTH = f"""WITH {_WG}, {_weights(10_000)}, lw AS (SELECT sample_id AS doc, {_WORDS} AS tok FROM train),
    lterms AS (SELECT doc, unnest(flatten(list_transform(list_transform(tok, lambda t: ' ' || t || ' '), lambda x: {_CW}))) AS term FROM lw),
    {_weights(15_000).replace("counts", "lcounts").replace("FROM terms", "FROM lterms").replace("stats", "lstats").replace("vocab", "lvocab").replace("raw AS", "lraw AS").replace("FROM raw", "FROM lraw").replace("weighted", "lweighted").replace("n AS (SELECT count(*) AS n FROM train), ", "")},
    z AS (SELECT count(*) AS width FROM vocab), b AS (SELECT doc, idx, value FROM weighted UNION ALL SELECT doc, idx + width, value FROM lweighted, z)"""


@query(f"{_BOTH} SELECT doc, idx, round(value, 6) AS value FROM b")
def tfidf_fused(spark, d):
    """Word and letter terms side by side, as one estimator gives them."""
    return _weighed(spark, d)


@query(f"{_BOTH}, m AS (SELECT max(width) AS width FROM z) SELECT doc, idx, round(value, 6) AS value FROM b, m WHERE idx >= width AND idx < width + 100")
def tfidf_char_slice(spark, d):
    """The first hundred letter columns of the whole vector, taken by a slicer."""
    from pyspark.ml.functions import vector_to_array

    x = tfidf.TfIdf().fit(_texts(spark, d), "sample_id", "processed_text")
    start, end = x.offsets()[1:]
    part = compose.columns_of(x.vectors(_texts(spark, d), "processed_text"), range(start, min(start + 100, end)))
    cells = part.select(F.col("sample_id").alias("doc"), F.posexplode(vector_to_array("part")).alias("k", "value")).where("value <> 0")
    return cells.select("doc", (F.col("k") + start).cast("long").alias("idx"), F.round("value", 6).alias("value"))


def _composed(spark, d, name: str) -> tuple[DataFrame, int]:
    """All training rows with a composed extractor's vectors at full size, and where the columns behind the terms start."""
    rows = spread(read(spark, d, "train").select("sample_id", "text", "processed_text"))
    x = compose.extractor(name).fit(rows, "sample_id", "text", "processed_text")
    return x.transform(rows, "sample_id", "text", "processed_text"), x.tfidf.shape()[1]


def _cells(spark, d, name: str) -> DataFrame:
    """(sample_id, width, terms, nonzero, dense): the vector's width, how many terms it has, its other columns as they are."""
    from pyspark.ml.functions import vector_to_array

    rows, start = _composed(spark, d, name)
    v = vector_to_array("features")
    dense = F.transform(F.slice(v, start + 1, F.size(v) - start), lambda y: F.round(y, 4))
    nonzero = F.size(F.filter(F.slice(v, 1, start), lambda y: y != 0))
    return rows.select("sample_id", F.size(v).alias("width"), nonzero.alias("terms"), F.array_join(F.transform(dense, lambda y: y.cast("string")), " ").alias("dense"))


@query()
def features_e8(spark, d):
    """Term, emoji, sentiment and negation features of all training rows in one vector of 25,000 term columns and more."""
    return _cells(spark, d, "E8")


@query()
def features_champion(spark, d):
    return _cells(spark, d, "champion")
