"""Deduplication, audits, harmonisation, set operations, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.text import ENTITY, MENTION, TAG, URL, WS
from ..operators import audit, dedup, harmonise, sets, splitting
from ..schema import LABELS
from ..session import read, spread
from . import sql as S
from .registry import query

H = "harmonized_pre_dedup"
_VECTOR = " || ".join(f"coalesce({c}::VARCHAR, '_')" for c in LABELS)
_KEY = S.squeeze(f"nfc_normalize({S.text('text')})")


def _filled(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND trim({c}) NOT IN ('', 'nan', 'None') THEN 1 ELSE 0 END"


_RANK = (
    f"-({_filled('domain')} + {_filled('topic')}), CASE source_dataset WHEN 'EmoNoBa' THEN 0 WHEN 'UBMEC' THEN 1 WHEN 'MONOVAB' THEN 2 ELSE 3 END, "
    "CASE source_split WHEN 'Train' THEN 0 WHEN 'Val' THEN 1 WHEN 'Test' THEN 2 WHEN 'NONE' THEN 3 ELSE 4 END, coalesce(source_row_id, 999999999), internal_id"
)
_ANNOTATED = f"""
keyed AS (SELECT *, {_KEY} AS k, {_VECTOR} AS v FROM {H}),
stats AS (SELECT k, count(*) AS group_size, count(DISTINCT v) AS n_label_vectors, count(DISTINCT source_dataset) AS n_sources,
    count(DISTINCT CASE WHEN source_dataset = 'EmoNoBa' THEN coalesce(source_split, 'NONE') END) AS n_splits FROM keyed GROUP BY k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {_RANK}) AS rn FROM keyed),
base AS (SELECT *, CASE WHEN n_label_vectors > 1 AND n_sources = 1 THEN 'B' WHEN n_label_vectors > 1 THEN 'D' WHEN n_sources > 1 THEN 'C' WHEN n_splits > 1 THEN 'E' ELSE 'A' END AS b FROM stats),
typed AS (SELECT *, CASE WHEN group_size = 1 THEN NULL WHEN n_splits > 1 AND n_sources > 1 THEN 'E+' || b WHEN n_splits > 1 AND n_label_vectors > 1 THEN 'E+B' ELSE b END AS group_type FROM base),
annotated AS (SELECT ranked.*, substr(sha1(ranked.k), 1, 12) AS group_id, group_size, n_label_vectors, n_sources, n_splits, group_type, rn = 1 AS is_canonical,
    CASE WHEN group_size = 1 THEN 'KEPT_AS_IS' WHEN n_label_vectors > 1 THEN 'RETAINED_UNRESOLVED' WHEN rn = 1 THEN 'CANONICAL_KEPT' ELSE 'COLLAPSED_INTO_CANONICAL' END AS action
    FROM ranked JOIN typed USING (k))"""


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, H)


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    cols = ["internal_id", "source_dataset", "source_split", "source_row_id", "text", "domain", "topic", *LABELS]
    return dedup.annotated(spread(_comments(spark, d).select(*cols)), T.comparison_key(F.col("text")))


@query(f"WITH {_ANNOTATED} SELECT internal_id, group_id, group_size, group_type, is_canonical, action FROM annotated")
def dedup_actions(spark, d):
    return _annotated(spark, d).select("internal_id", "group_id", "group_size", "group_type", "is_canonical", "action")


@query(f"""WITH {_ANNOTATED} SELECT group_id, any_value(group_type) AS group_type, any_value(group_size) AS n_rows, any_value(n_sources) AS n_sources,
    string_agg(DISTINCT source_dataset, '|' ORDER BY source_dataset) AS sources, any_value(n_sources) > 1 AS is_cross_source, any_value(n_splits) > 1 AS is_cross_split,
    any_value(n_label_vectors) > 1 AS is_conflicting, any_value(n_label_vectors) AS n_label_vectors, CASE WHEN any_value(n_label_vectors) > 1 THEN 'RETAINED_UNRESOLVED' ELSE 'COLLAPSED' END AS action
    FROM annotated WHERE group_size > 1 GROUP BY k, group_id""")
def dedup_groups(spark, d):
    return dedup.groups(_annotated(spark, d))


@query(f"WITH {_ANNOTATED} SELECT internal_id, group_id FROM annotated WHERE action = 'CANONICAL_KEPT'")
def dedup_canonical(spark, d):
    return _annotated(spark, d).where("action = 'CANONICAL_KEPT'").select("internal_id", "group_id")


@query(f"""WITH {_ANNOTATED} SELECT group_id, group_type, internal_id, source_dataset, source_split, source_row_id, is_canonical AND action <> 'RETAINED_UNRESOLVED' AS is_canonical,
    CASE WHEN group_size = 1 THEN 'singleton' WHEN n_label_vectors > 1 THEN 'conflicting' ELSE 'identical' END AS conflict_status, action,
    CASE WHEN action = 'COLLAPSED_INTO_CANONICAL' THEN group_id END AS canonical_group_id, v AS label_vector FROM annotated""")
def dedup_provenance(spark, d):
    return dedup.provenance(_annotated(spark, d))


@query(f"""WITH {_ANNOTATED} SELECT internal_id, source_dataset, source_split FROM annotated WHERE action <> 'COLLAPSED_INTO_CANONICAL'""")
def dedup_output(spark, d):
    return dedup.in_order(dedup.deduplicated(_annotated(spark, d))).select("internal_id", "source_dataset", "source_split")


@query(f"""WITH {_ANNOTATED} SELECT count(*) AS rows_in, count_if(action <> 'COLLAPSED_INTO_CANONICAL') AS rows_out, count_if(action = 'COLLAPSED_INTO_CANONICAL') AS collapsed,
    count_if(action = 'KEPT_AS_IS') AS singletons, count_if(action = 'CANONICAL_KEPT') AS canonical, count_if(action = 'RETAINED_UNRESOLVED') AS retained, true AS balanced FROM annotated""")
def dedup_accounting(spark, d):
    return dedup.accounting(_annotated(spark, d))


@query(f"""SELECT internal_id FROM (SELECT internal_id, row_number() OVER (PARTITION BY lower({S.strip(S.text('text'))}) ORDER BY internal_id) AS n FROM {H}) WHERE n = 1""")
def dedup_keep_first(spark, d):
    return dedup.keep_first(_comments(spark, d).select("internal_id", "text"), T.simple_key(F.col("text")), "internal_id").select("internal_id")


@query(f"""WITH {_ANNOTATED}, s AS (SELECT k, string_agg(DISTINCT source_dataset, '+' ORDER BY source_dataset) AS sources FROM annotated WHERE group_size > 1 GROUP BY k)
    SELECT sources, count(*) AS groups FROM s GROUP BY sources""")
def dedup_source_sets(spark, d):
    rows = _comments(spark, d).select("source_dataset", F.sha1(T.comparison_key(F.col("text")).cast("binary")).alias("k"))
    return audit.source_sets(rows, "k", "source_dataset")


@query(f"""WITH {_ANNOTATED} SELECT group_id, count(*) AS n_rows, string_agg(internal_id::VARCHAR, '|' ORDER BY internal_id) AS internal_ids, string_agg(source_dataset, '|' ORDER BY internal_id) AS datasets,
    string_agg(v, '|' ORDER BY internal_id) AS label_vectors FROM annotated WHERE group_size > 1 AND n_label_vectors > 1 GROUP BY k, group_id""")
def conflict_groups(spark, d):
    return dedup.conflicts(_annotated(spark, d))


@query(f"WITH {_ANNOTATED} SELECT group_id, group_size::BIGINT AS n_rows, internal_id, source_dataset, v AS label_vector FROM annotated WHERE group_size > 1 AND n_label_vectors > 1")
def conflict_members(spark, d):
    return dedup.conflict_members(_annotated(spark, d))


@query(f"""WITH {_ANNOTATED}, bad AS (SELECT * FROM annotated WHERE group_size > 1 AND n_label_vectors > 1)
    SELECT internal_id FROM keyed WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.source_dataset = keyed.source_dataset AND bad.source_row_id = keyed.source_row_id) AND k NOT IN (SELECT k FROM bad)""")
def conflict_drop(spark, d):
    rows = _comments(spark, d).select("internal_id", "source_dataset", "source_row_id", "text")
    return dedup.without_conflicts(rows, _annotated(spark, d), T.comparison_key(F.col("text"))).select("internal_id")


_DIFFER = " OR ".join(f"count(DISTINCT {c}) > 1" for c in LABELS)


@query(f"SELECT text, count(*) AS n FROM {H} WHERE text IS NOT NULL GROUP BY text HAVING {_DIFFER}")
def conflict_texts(spark, d):
    return audit.conflicting_texts(_comments(spark, d))


@query(f"""WITH c AS (SELECT text FROM {H} WHERE text IS NOT NULL GROUP BY text HAVING {_DIFFER} ORDER BY text LIMIT 10)
    SELECT text, internal_id, {', '.join(LABELS)} FROM {H} WHERE text IN (SELECT text FROM c)""")
def conflict_samples(spark, d):
    return audit.conflict_samples(_comments(spark, d), "internal_id")


@query(f"""WITH {_ANNOTATED}, bad AS (SELECT source_dataset, source_row_id FROM annotated WHERE group_size > 1 AND n_label_vectors > 1)
    SELECT internal_id FROM {H} h WHERE EXISTS (SELECT 1 FROM bad WHERE bad.source_dataset = h.source_dataset AND bad.source_row_id = h.source_row_id)""")
def conflict_semi(spark, d):
    bad = _annotated(spark, d).where("group_size > 1 and n_label_vectors > 1").select("source_dataset", "source_row_id").distinct()
    return _comments(spark, d).select("internal_id", "source_dataset", "source_row_id").join(bad, ["source_dataset", "source_row_id"], "left_semi").select("internal_id")


@query(f"""WITH {_ANNOTATED}, c AS (SELECT group_id, string_agg(internal_id::VARCHAR, '|' ORDER BY internal_id) AS i, string_agg(source_dataset, '|' ORDER BY internal_id) AS s FROM annotated WHERE group_size > 1 AND n_label_vectors > 1 GROUP BY k, group_id)
    SELECT group_id, unnest(string_split(i, '|')) AS internal_ids, unnest(string_split(s, '|')) AS datasets FROM c""")
def conflict_unnested(spark, d):
    return sets.unnested(dedup.conflicts(_annotated(spark, d)).select("group_id", "internal_ids", "datasets"), ["internal_ids", "datasets"])


# -- audits --------------------------------------------------------------------


@query(f"""WITH r AS (SELECT text AS raw, {S.strip('text')} AS stripped, {S.squeeze('nfc_normalize(text)')} AS normalised FROM {H}),
    a AS (SELECT count(*) AS total, count_if(raw IS NULL) AS nulls, count_if(raw = '') AS empty, count_if(raw <> '' AND stripped = '') AS blank,
        count(DISTINCT raw) AS distinct_raw, count(DISTINCT stripped) AS distinct_stripped, count(DISTINCT normalised) AS distinct_normalised FROM r)
    SELECT *, total - distinct_raw AS duplicates_raw, total - distinct_stripped AS duplicates_stripped, total - distinct_normalised AS duplicates_normalised FROM a""")
def text_audit(spark, d):
    return audit.text_audit(_comments(spark, d))


@query(f"""WITH r AS (SELECT 'chars' AS measure, length(text) AS x FROM {H} WHERE text IS NOT NULL UNION ALL SELECT 'words', len({S.tok('text')}) FROM {H} WHERE text IS NOT NULL)
    SELECT measure, min(x) AS min, max(x) AS max, round(avg(x), 2) AS mean, round(quantile_cont(x, 0.5), 2) AS median, round(stddev_samp(x), 2) AS std,
        round(quantile_cont(x, 0.25), 2) AS q25, round(quantile_cont(x, 0.75), 2) AS q75 FROM r GROUP BY measure""")
def length_stats(spark, d):
    return audit.length_stats(_comments(spark, d))


@query(f"""WITH r AS (SELECT regexp_matches({S.text('text')}, '{S.BN}') AS b, regexp_matches({S.text('text')}, '[a-zA-Z]') AS l, regexp_matches({S.text('text')}, '{URL}') AS u, regexp_matches({S.text('text')}, '{MENTION}') AS m FROM {H})
    SELECT count_if(b AND NOT l) AS pure_bangla, count_if(b AND l) AS mixed, count_if(NOT b AND l) AS latin_only, count_if(NOT b AND NOT l) AS neither, count_if(u) AS with_url, count_if(m) AS with_mention FROM r""")
def script_breakdown(spark, d):
    return audit.script_breakdown(_comments(spark, d))


@query(f"SELECT original_class AS value, count(*) AS n FROM {H} GROUP BY 1")
def value_counts(spark, d):
    return audit.value_counts(_comments(spark, d), "original_class")


@query(f"SELECT {S.label_sum()} AS labels, count(*) AS n FROM {H} GROUP BY 1")
def label_cardinality(spark, d):
    return audit.label_cardinality(_comments(spark, d))


@query(f"SELECT round(avg({S.label_sum()}), 4) AS mean_labels FROM {H}")
def mean_labels(spark, d):
    return audit.mean_labels(_comments(spark, d))


@query(f"WITH u AS ({S.unpivoted(H)}) SELECT label, sum(y)::BIGINT AS positives, count(*) AS n, round(100 * sum(y) / count(*), 2) AS pct FROM u GROUP BY label")
def label_prevalence(spark, d):
    return audit.prevalence(_comments(spark, d))


@query(f"WITH u AS ({S.unpivoted(H, 'source_dataset')}) SELECT source_dataset, label, sum(y)::BIGINT AS positives, count(*) AS n, round(100 * sum(y) / count(*), 2) AS pct FROM u GROUP BY source_dataset, label")
def label_prevalence_by_source(spark, d):
    return audit.prevalence(_comments(spark, d), ["source_dataset"])


@query(f"WITH u AS ({S.unpivoted(H, 'source_split')}) SELECT source_split, label, sum(y)::BIGINT AS positives, count(*) AS n, round(100 * sum(y) / count(*), 2) AS pct FROM u GROUP BY source_split, label")
def label_prevalence_by_split(spark, d):
    return audit.prevalence(_comments(spark, d), ["source_split"])


@query(f"SELECT 'topic' AS column, count(DISTINCT topic) AS distinct_values FROM {H} UNION ALL SELECT 'domain', count(DISTINCT domain) FROM {H} UNION ALL SELECT 'thread_key', count(DISTINCT thread_key) FROM {H}")
def metadata_counts(spark, d):
    return audit.metadata_counts(_comments(spark, d), ["topic", "domain", "thread_key"])


@query(f"SELECT topic AS value, count(*) AS n FROM {H} WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, value LIMIT 20")
def top_topics(spark, d):
    return audit.top_values(_comments(spark, d), "topic", 20)


_ROW = "source_dataset, source_split, source_row_id, text, " + ", ".join(LABELS)


@query(f"WITH g AS (SELECT count(*) AS c FROM {H} GROUP BY {_ROW}) SELECT (sum(c) - count(*))::BIGINT AS duplicates FROM g")
def full_row_duplicates(spark, d):
    return audit.full_row_duplicates(_comments(spark, d).select("source_dataset", "source_split", "source_row_id", "text", *LABELS))


@query(f"SELECT count_if(NOT regexp_matches({S.text('text')}, '\\p{{L}}')) AS no_letter, count_if(regexp_matches({S.text('text')}, '{S.BN}') AND regexp_matches({S.text('text')}, '[a-zA-Z]')) AS mixed_script FROM {H}")
def text_anomalies(spark, d):
    return audit.anomalies(_comments(spark, d))


@query(f"SELECT source_dataset, count(*) AS n FROM {H} WHERE {S.label_sum()} = 0 GROUP BY source_dataset")
def unlabelled_rows(spark, d):
    return audit.unlabelled(_comments(spark, d))


def _check(name: str, rule: str) -> str:
    return f"SELECT '{name}' AS check, count_if(NOT coalesce({rule}, false)) = 0 AS passed, count_if(NOT coalesce({rule}, false)) AS violations FROM {H}"


_RULES = {f"binary_{c}": f"{c} IN (0, 1)" for c in LABELS} | {
    "text_present": "text IS NOT NULL", "single_label_one_hot": f"source_dataset <> 'UBMEC' OR {' + '.join(LABELS)} = 1",
    "assumption_flagged": "emonoba_disgust_assumption = (source_dataset = 'EmoNoBa')", "assumed_disgust_zero": "NOT emonoba_disgust_assumption OR disgust = 0",
}


@query(" UNION ALL ".join(_check(k, v) for k, v in _RULES.items()))
def invariant_checks(spark, d):
    return audit.checks(_comments(spark, d), audit.harmonised_rules())


@query(f"WITH u AS ({S.unpivoted(H)}), s AS (SELECT label, sum(y)::BIGINT AS positives FROM u GROUP BY label) SELECT label, positives, row_number() OVER (ORDER BY positives DESC, list_position({S.array(LABELS)}, label) DESC) AS place FROM s")
def label_order(spark, d):
    return audit.label_order(_comments(spark, d))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, coalesce(sum(CASE WHEN {a} = 1 AND {b} = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS n FROM {H}" for a in LABELS for b in LABELS))
def label_cooccurrence(spark, d):
    return audit.cooccurrence(_comments(spark, d))


@query()
def greedy_label_order(spark, d):
    order = audit.greedy_label_order(_comments(spark, d))
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(order)], "place int, label string")


# -- set operations --------------------------------------------------------------


def _texts(spark, d) -> dict[str, DataFrame]:
    rows = _comments(spark, d).select("source_dataset", F.regexp_replace("text", rf"^{WS}+|{WS}+$", "").alias("t"))
    return {k: rows.where(F.col("source_dataset") == k).select("t") for k in ("EmoNoBa", "UBMEC", "MONOVAB")}


def _set(k: str) -> str:
    return f"SELECT {S.strip('text')} AS t FROM {H} WHERE source_dataset = '{k}' AND text IS NOT NULL"


@query(" UNION ALL ".join(f"SELECT '{a}&{b}' AS sets, count(*) AS n FROM ({_set(a)} INTERSECT {_set(b)})" for a, b in (("EmoNoBa", "UBMEC"), ("EmoNoBa", "MONOVAB"), ("UBMEC", "MONOVAB")))
       + f" UNION ALL SELECT 'EmoNoBa&UBMEC&MONOVAB', count(*) FROM ({_set('EmoNoBa')} INTERSECT {_set('UBMEC')} INTERSECT {_set('MONOVAB')})")
def overlap_counts(spark, d):
    return sets.overlap_counts(_texts(spark, d))


@query(f"""WITH u AS (SELECT DISTINCT source_dataset, {S.strip('text')} AS t FROM {H} WHERE text IS NOT NULL), g AS (SELECT t, count(*) AS n FROM u GROUP BY t)
    SELECT count(*) AS union_distinct, coalesce(sum(n - 1), 0)::BIGINT AS duplicates_across FROM g""")
def union_unique(spark, d):
    return sets.union_counts(_texts(spark, d))


@query(f"""WITH e AS (SELECT DISTINCT source_split, {_KEY} AS k FROM {H} WHERE source_split IN ('Train', 'Val', 'Test'))
    SELECT a.source_split || '&' || b.source_split AS pair, count(*) AS n FROM e a JOIN e b ON a.k = b.k AND a.source_split < b.source_split GROUP BY 1""")
def split_overlap(spark, d):
    rows = _comments(spark, d).where("source_split in ('Train', 'Val', 'Test')").select("source_split", T.comparison_key(F.col("text")).alias("k")).distinct()
    held = rows.groupBy("k").agg(F.array_sort(F.collect_set("source_split")).alias("s")).where("size(s) > 1")
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.concat(a, F.lit("&"), b))))
    return held.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


@query(f"SELECT sample_id, 'before' AS side FROM (SELECT sample_id FROM train EXCEPT ALL SELECT sample_id FROM train WHERE processed_text <> '') UNION ALL SELECT sample_id, 'after' FROM (SELECT sample_id FROM train WHERE processed_text <> '' EXCEPT ALL SELECT sample_id FROM train)")
def nothing_lost(spark, d):
    rows = read(spark, d, "train")
    return sets.lost(rows.select("sample_id"), rows.where("processed_text <> ''").select("sample_id"))


# -- harmonisation ------------------------------------------------------------------


def _native_multi(spark, d) -> DataFrame:
    """The multi-label source as it was delivered, from its harmonised rows."""
    rows = _comments(spark, d).where("source_dataset = 'EmoNoBa'")
    return rows.select(F.col("internal_id").alias("ID"), F.col("text").alias("Data"), F.col("original_love").alias("Love"), *(F.col(c).alias(c.capitalize()) for c in LABELS if c != "disgust"), F.col("topic").alias("Topic"), F.col("domain").alias("Domain"), "source_split")


def _native_seven(spark, d) -> DataFrame:
    rows = _comments(spark, d).where("source_dataset = 'MONOVAB'")
    return rows.select(F.col("internal_id").alias("Unnamed: 0"), F.col("text").alias("comment"), "anger", F.col("original_contempt").alias("contempt"), "disgust", F.col("original_enjoyment").alias("enjoyment"), "fear", "sadness", "surprise")


def _sources(spark, d):
    return ((_native_multi(spark, d), harmonise.multi_label(split=F.col("source_split"))), (read(spark, d, "ubmec_raw"), harmonise.single_label()), (_native_seven(spark, d), harmonise.seven_label()))


_OWN = {"anger", "fear", "joy", "sadness", "surprise"}
_MULTI = f"SELECT 'EmoNoBa' AS source_dataset, source_split, internal_id AS source_row_id, text, anger, 0 AS disgust, fear, joy, sadness, surprise, original_love, NULL::VARCHAR AS original_class, NULL::BIGINT AS original_contempt, NULL::BIGINT AS original_enjoyment, domain, topic, coalesce(original_love = 1 AND anger + fear + joy + sadness + surprise = 0, false) AS bad, 'love_only' AS rule, true AS assumed FROM {H} WHERE source_dataset = 'EmoNoBa'"
_SINGLE = "SELECT 'UBMEC' AS source_dataset, 'NONE' AS source_split, row_no AS source_row_id, text, " + ", ".join(f"(lower(trim(classes)) = '{c}')::INT AS {c}" for c in LABELS) + f", NULL::BIGINT AS original_love, classes AS original_class, NULL::BIGINT AS original_contempt, NULL::BIGINT AS original_enjoyment, NULL::VARCHAR AS domain, NULL::VARCHAR AS topic, NOT coalesce(lower(trim(classes)) IN ({', '.join(map(S.quoted, LABELS))}), false) AS bad, 'unknown_class' AS rule, false AS assumed FROM ubmec_raw"
_SEVEN = f"SELECT 'MONOVAB' AS source_dataset, 'NONE' AS source_split, internal_id AS source_row_id, text, anger, disgust, fear, original_enjoyment::INT AS joy, sadness, surprise, NULL::BIGINT AS original_love, NULL::VARCHAR AS original_class, original_contempt, original_enjoyment, NULL::VARCHAR AS domain, NULL::VARCHAR AS topic, coalesce(original_contempt = 1 AND anger + disgust + coalesce(original_enjoyment, 0) + fear + sadness + surprise = 0, false) AS bad, 'contempt_only' AS rule, false AS assumed FROM {H} WHERE source_dataset = 'MONOVAB'"
_ALL = f"src AS ({_MULTI} UNION ALL {_SINGLE} UNION ALL {_SEVEN})"


@query(f"WITH {_ALL} SELECT source_dataset, source_split, source_row_id, text, {', '.join(LABELS)}, assumed AS emonoba_disgust_assumption, assumed AS f5_eligible, original_love, original_class, original_contempt, original_enjoyment, domain, topic FROM src WHERE NOT bad")
def harmonize_union(spark, d):
    return harmonise.ordered_columns(harmonise.union_all(*(harmonise.harmonised(df, s) for df, s in _sources(spark, d))))


_AFTER = " || '|' || ".join(f"'{c}=' || {c}::VARCHAR" for c in LABELS)


def _manifest(spark, d) -> DataFrame:
    return harmonise.union_all(*(harmonise.manifest(df, s) for df, s in _sources(spark, d)))


@query(f"WITH {_ALL} SELECT source_dataset, source_split, source_row_id, NOT bad AS included, CASE WHEN bad THEN rule ELSE '' END AS reason, CASE WHEN bad THEN '' ELSE {_AFTER} END AS labels_after, substr({S.text('text')}, 1, 80) AS text_start FROM src")
def harmonize_manifest(spark, d):
    return _manifest(spark, d)


@query(f"WITH {_ALL} SELECT source_dataset, rule AS reason, count(*) AS n FROM src WHERE bad GROUP BY 1, 2")
def exclusion_log(spark, d):
    return _manifest(spark, d).where("not included").groupBy("source_dataset", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {_ALL} SELECT source_dataset, CASE WHEN bad THEN rule ELSE 'mapped' END AS rule, count(*) AS affected FROM src GROUP BY 1, 2")
def transformation_log(spark, d):
    return harmonise.transformation_log(_manifest(spark, d))


@query("SELECT row_no, " + ", ".join(f"(lower(trim(classes)) = '{c}')::INT AS {c}" for c in LABELS) + f" FROM ubmec_raw WHERE lower(trim(classes)) IN ({', '.join(map(S.quoted, LABELS))})")
def one_hot(spark, d):
    source = harmonise.single_label()
    rows = read(spark, d, "ubmec_raw").where(harmonise.reason(source).isNull())
    return rows.select("row_no", *(source.labels[c].alias(c) for c in LABELS))


@query(f"SELECT internal_id, CASE WHEN source_dataset = 'EmoNoBa' THEN coalesce(original_love, 0)::INT END AS love FROM {H}")
def nullable_label(spark, d):
    return harmonise.with_love(_comments(spark, d)).select("internal_id", "love")


@query(f"WITH {_ALL} SELECT source_row_id, text, original_love FROM src WHERE bad AND rule = 'love_only'")
def reincluded_rows(spark, d):
    df, source = _sources(spark, d)[0]
    return harmonise.reincluded(df, source).select("source_row_id", "text", "original_love")


_BASE = f"upper(substr(source_dataset, 1, 3)) || '-' || coalesce(source_row_id::VARCHAR, 'NA') || '-' || substr(sha1({S.text('text')}), 1, 8)"


@query(f"WITH b AS (SELECT internal_id, {_BASE} AS base FROM {H}) SELECT internal_id, base, count(*) OVER (PARTITION BY base) AS shared FROM b")
def sample_ids(spark, d):
    base = F.concat_ws("-", F.upper(F.substring("source_dataset", 1, 3)), F.coalesce(F.col("source_row_id").cast("string"), F.lit("NA")), T.short_hash(F.coalesce(F.col("text"), F.lit("")), 8))
    rows = _comments(spark, d).select("internal_id", base.alias("base"))
    return rows.join(rows.groupBy("base").agg(F.count("*").alias("shared")), "base").select("internal_id", "base", "shared")


@query("SELECT source_dataset, coalesce(native_label, '') AS native_label, target_label, status FROM label_mapping")
def label_mapping_table(spark, d):
    return harmonise.label_mapping(spark)


# -- cleaning -------------------------------------------------------------------------

_DIRTY = "' http://x.y/z @someone <b> &amp; wow!!!! '"
_RAW = f"({S.text('text')} || {_DIRTY})"


def _dirty() -> F.Column:
    return F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit(_DIRTY.strip("'")))


def _sql_bangla(t: str) -> str:
    out = f"translate({S.squeeze(t)}, '​‌⁠﻿', '')"
    from ..functions.lexicons import COMPOSED

    for two, one in COMPOSED:
        out = f"replace({out}, '{two}', '{one}')"
    return out


def _sql_marks(t: str) -> str:
    for c in T.REPEATABLE:
        escaped = "\\" + c if c in "?.-" else c
        t = f"regexp_replace({t}, '{escaped}{{3,}}', '{c}{c}', 'g')"
    return t


_URLS = f"regexp_replace({_RAW}, '{URL}', ' ', 'g')"
_MENTIONS = f"regexp_replace({_URLS}, '{MENTION}', ' ', 'g')"
_HTML = f"regexp_replace(regexp_replace({_MENTIONS}, '{TAG}', ' ', 'g'), '{ENTITY}', ' ', 'g')"
_CLEAN = S.squeeze(_sql_marks(_sql_bangla(_HTML)))


@query(f"SELECT internal_id, {_URLS} AS t FROM {H}")
def clean_url(spark, d):
    return spread(_comments(spark, d).select("internal_id", "text")).select("internal_id", T.without_urls(_dirty()).alias("t"))


@query(f"SELECT internal_id, regexp_replace({_RAW}, '{MENTION}', ' ', 'g') AS t FROM {H}")
def clean_mention(spark, d):
    return spread(_comments(spark, d).select("internal_id", "text")).select("internal_id", T.without_mentions(_dirty()).alias("t"))


@query(f"SELECT internal_id, regexp_replace(regexp_replace({_RAW}, '{TAG}', ' ', 'g'), '{ENTITY}', ' ', 'g') AS t FROM {H}")
def clean_html(spark, d):
    return spread(_comments(spark, d).select("internal_id", "text")).select("internal_id", T.without_markup(_dirty()).alias("t"))


@query(f"SELECT internal_id, {_sql_marks(_RAW)} AS t FROM {H}")
def clean_punct(spark, d):
    return spread(_comments(spark, d).select("internal_id", "text")).select("internal_id", T.shortened_marks(_dirty()).alias("t"))


@query(f"SELECT internal_id, {_sql_bangla(S.text('text'))} AS t FROM {H}")
def clean_bangla(spark, d):
    return spread(_comments(spark, d).select("internal_id", "text")).select("internal_id", T.normalised_bangla(F.coalesce(F.col("text"), F.lit(""))).alias("t"))


@query(f"SELECT internal_id, {_CLEAN} AS t FROM {H}")
def clean_all(spark, d):
    return spread(_comments(spark, d).select("internal_id", "text")).select("internal_id", T.cleaned(_dirty()).alias("t"))


_NEG = S.L.lexicon(S.L.NEGATIONS)


@query(f"""WITH r AS (SELECT sample_id, list_distinct(list_filter({S.tok('text')}, lambda x: list_contains({S.array(_NEG)}, x))) AS had, {S.tok('processed_text')} AS after FROM train)
    SELECT sample_id, list_sort(list_filter(had, lambda x: list_contains(after, x))) AS present, list_sort(list_filter(had, lambda x: NOT list_contains(after, x))) AS lost, len(list_filter(had, lambda x: NOT list_contains(after, x))) = 0 AS all_preserved FROM r""")
def word_preservation(spark, d):
    parts = T.preserved(F.col("text"), F.col("processed_text"), _NEG)
    return read(spark, d, "train").select("sample_id", *(c.alias(k) for k, c in parts.items()))


@query(f"""SELECT internal_id, coalesce(regexp_matches(text, '{URL}'), false) AS had_url, coalesce(regexp_matches(text, '{MENTION}'), false) AS had_mention, coalesce(regexp_matches(text, '[\\x{{10000}}-\\x{{10ffff}}]'), false) AS had_astral,
    coalesce(regexp_matches(text, '[?!.,;:\\-_।]{{3,}}'), false) AS had_marks, coalesce(regexp_matches(text, '{TAG}'), false) AS had_html FROM {H}""")
def spot_flags(spark, d):
    return _comments(spark, d).select("internal_id", *(c.alias(k) for k, c in T.spot_flags(F.col("text")).items()))


# -- splits, samples, weights ------------------------------------------------------------

_COMB = " || ".join(f"coalesce({c}::VARCHAR, '0')" for c in LABELS)


def _sql_split(stratum: str, key: str = "internal_id", table: str = H) -> str:
    part = f"PARTITION BY {stratum}" if stratum else ""
    offset = f"('0x' || substr(md5(({stratum}) || ':42'), 1, 4))::BIGINT / 65536::DOUBLE" if stratum else "0.5"
    return f"""WITH r AS (SELECT {key}, count(*) OVER ({part}) AS n, row_number() OVER ({part} ORDER BY md5({key}::VARCHAR || ':42'), {key}) AS r, {offset} AS u FROM {table})
        SELECT {key}, CASE WHEN r <= floor(n * 0.7::DOUBLE + u) THEN 'train' WHEN r <= floor(n * 0.85::DOUBLE + u) THEN 'val' ELSE 'test' END AS split FROM r"""


@query(_sql_split(_COMB))
def split_stratified(spark, d):
    return splitting.stratified_split(_comments(spark, d).select("internal_id", *LABELS), "internal_id").select("internal_id", "split")


@query(_sql_split(_COMB + " || CASE WHEN source_dataset = 'EmoNoBa' THEN coalesce(original_love, 0)::VARCHAR ELSE '0' END"))
def split_stratified_7(spark, d):
    rows = harmonise.with_love(_comments(spark, d)).select("internal_id", *LABELS, "love")
    return splitting.stratified_split(rows, "internal_id", (*LABELS, "love")).select("internal_id", "split")


@query(_sql_split(""))
def split_random(spark, d):
    return splitting.random_split(_comments(spark, d).select("internal_id"), "internal_id").select("internal_id", "split")


_CHECKED = f"s AS ({_sql_split(_COMB)}), per AS (SELECT internal_id, count(DISTINCT split) AS n, count(*) FILTER (WHERE split IS NULL) AS without FROM s GROUP BY internal_id), j AS (SELECT s.split, h.* FROM s JOIN {H} h USING (internal_id))"
_PRESENT = " UNION ALL ".join(f"SELECT '{c}_in_{p}', count(*) FILTER (WHERE split = '{p}' AND {c} = 1) > 0 FROM j" for c in LABELS for p in ("train", "val", "test"))


@query(f"WITH {_CHECKED} SELECT 'disjoint' AS \"check\", count(*) FILTER (WHERE n > 1) = 0 AS passed FROM per UNION ALL SELECT 'complete', count(*) FILTER (WHERE without > 0) = 0 FROM per UNION ALL {_PRESENT}")
def split_checks(spark, d):
    rows = splitting.stratified_split(_comments(spark, d).select("internal_id", *LABELS), "internal_id")
    return splitting.split_checks(rows, "internal_id")


@query(f"SELECT internal_id FROM {H} ORDER BY md5(internal_id::VARCHAR || ':42'), internal_id LIMIT 50")
def seeded_sample(spark, d):
    return splitting.sample(_comments(spark, d).select("internal_id"), "internal_id", 50)


@query(f"SELECT internal_id, 0 AS copy, '' AS for_label FROM {H} UNION ALL SELECT internal_id, 1, 'fear' FROM {H} WHERE fear = 1 UNION ALL SELECT internal_id, unnest([1, 2]), 'disgust' FROM {H} WHERE disgust = 1")
def oversample(spark, d):
    rows = _comments(spark, d).select("internal_id", "fear", "disgust")
    return splitting.oversampled(rows, "internal_id", {"fear": 2, "disgust": 3}).select("internal_id", "copy", "for_label")


@query(f"WITH u AS ({S.unpivoted(H)}) SELECT label, round(count(*) / (2 * nullif(count_if(y = 0), 0)), 6) AS weight_0, round(count(*) / (2 * nullif(count_if(y = 1), 0)), 6) AS weight_1 FROM u GROUP BY label")
def class_weights(spark, d):
    return splitting.class_weights(_comments(spark, d))


@query(f"SELECT internal_id, greatest(1.0, CASE WHEN fear = 1 THEN 2.0 ELSE 1.0 END, CASE WHEN disgust = 1 THEN 3.0 ELSE 1.0 END)::DOUBLE AS weight FROM {H}")
def sample_weights(spark, d):
    return _comments(spark, d).select("internal_id", splitting.sample_weight({"fear": 2, "disgust": 3}).alias("weight"))
