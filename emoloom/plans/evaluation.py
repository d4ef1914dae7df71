"""Thresholds, metrics, error analysis, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import features as X, text as T
from ..operators import audit, compose, metrics, models, runner, tfidf, thresholds
from ..schema import LABELS
from ..session import read, spread
from . import sql as S
from .registry import query

P = S.PRED


def _pred(spark, d) -> DataFrame:
    """Predictions with the source that an id begins with."""
    return read(spark, d, P).withColumn("source", F.substring("sample_id", 1, 3))


_LONG = f"l AS ({S.long_predictions(keep='substr(sample_id, 1, 3) AS source')})"
_CNT = "count_if(y = 1 AND p = 1) AS tp, count_if(y = 0 AND p = 1) AS fp, count_if(y = 1 AND p = 0) AS fn"
_PR, _RC, _F1 = S.ratio("tp", "tp + fp"), S.ratio("tp", "tp + fn"), S.ratio("2 * tp", "2 * tp + fp + fn")


@query(f"WITH {_LONG}, c AS (SELECT label, {_CNT} FROM l GROUP BY label) SELECT label, tp, fp, fn, round({_PR}, 4) AS precision, round({_RC}, 4) AS recall, round({_F1}, 4) AS f1 FROM c")
def metrics_per_label(spark, d):
    return metrics.per_label(_pred(spark, d))


_BOTH = " + ".join(f"CASE WHEN true_{c} = 1 AND pred_{c} = 1 THEN 1 ELSE 0 END" for c in LABELS)
_EITHER = " + ".join(f"CASE WHEN true_{c} = 1 OR pred_{c} = 1 THEN 1 ELSE 0 END" for c in LABELS)
_WRONG = " + ".join(f"CASE WHEN (true_{c} = 1) <> (pred_{c} = 1) THEN 1 ELSE 0 END" for c in LABELS)


def _overall(by: str = "") -> str:
    k = by + ", " if by else ""
    group, join = (f"GROUP BY {by}", f"USING ({by})") if by else ("", "ON true")
    return f"""WITH {_LONG}, c AS (SELECT {k}label, {_CNT} FROM l GROUP BY {k}label), s AS (SELECT *, {_PR} AS pr, {_RC} AS rc, {_F1} AS f FROM c),
    a AS (SELECT {k}avg(f) AS macro_f1, {S.ratio('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} AS micro_f1, avg(pr) AS macro_precision, avg(rc) AS macro_recall FROM s {group}),
    w AS (SELECT substr(sample_id, 1, 3) AS source, {_BOTH} AS b, {_EITHER} AS e, {_WRONG} AS w FROM {P}),
    z AS (SELECT {k}count(*) AS n, sum(w) / (count(*) * 6.0) AS hamming_loss, avg({S.ratio('b', 'e')}) AS jaccard, avg(CASE WHEN w = 0 THEN 1.0 ELSE 0.0 END) AS subset_accuracy FROM w {group})
    SELECT {k}n, round(macro_f1, 4) AS macro_f1, round(micro_f1, 4) AS micro_f1, round(macro_precision, 4) AS macro_precision, round(macro_recall, 4) AS macro_recall, round(jaccard, 4) AS jaccard,
        round(subset_accuracy, 4) AS subset_accuracy, round(hamming_loss, 6) AS hamming_loss FROM a JOIN z {join}"""


@query(_overall())
def metrics_global(spark, d):
    return metrics.overall(_pred(spark, d))


@query(_overall("source"))
def metrics_by_source(spark, d):
    return metrics.overall(_pred(spark, d), ["source"])


_PLACED = f"""p AS (SELECT * FROM {P} WHERE sample_id LIKE 'EMO-%'), h AS (SELECT source_row_id::VARCHAR AS row_id, lower(trim(domain)) AS domain FROM harmonized_pre_dedup WHERE source_dataset = 'EmoNoBa' AND lower(trim(domain)) NOT IN ('', 'nan', 'none')),
    m AS (SELECT row_id, min(domain) AS domain FROM h WHERE row_id IS NOT NULL GROUP BY row_id), q AS (SELECT p.*, coalesce(m.domain, '') AS domain FROM p LEFT JOIN m ON split_part(p.sample_id, '-', 2) = m.row_id)"""


@query(_overall("domain").replace(_LONG, f"{_PLACED}, l AS ({S.long_predictions('q', keep='domain')})", 1).replace("substr(sample_id, 1, 3) AS source,", "domain,").replace(f"AS w FROM {P})", "AS w FROM q)"))
def metrics_by_domain(spark, d):
    """Of the one source that has domains, the metrics by domain ('' where it is missing)."""
    rows = _pred(spark, d).where("sample_id like 'EMO-%'").withColumn("row_id", F.split("sample_id", "-")[1])
    place = F.lower(F.trim("domain"))
    known = read(spark, d, "harmonized_pre_dedup").where("source_dataset = 'EmoNoBa' and source_row_id is not null").where(~place.isin("", "nan", "none"))
    known = known.groupBy(F.col("source_row_id").cast("string").alias("row_id")).agg(F.min(place).alias("domain"))
    return metrics.overall(rows.join(known, "row_id", "left").withColumn("domain", F.coalesce("domain", F.lit(""))), ["domain"])


_PAIRS = []
for _a in LABELS:
    for _b in LABELS:
        if _a != _b:
            _PAIRS.append(f"SELECT 'cooccurrence' AS kind, '{_a}' AS a, '{_b}' AS b, count_if(true_{_a} = 1 AND true_{_b} = 1) AS n FROM {P}")
            _PAIRS.append(f"SELECT 'false_positive', '{_a}', '{_b}', count_if(pred_{_a} = 1 AND true_{_a} <> 1 AND true_{_b} = 1) FROM {P}")


@query(f"SELECT * FROM ({' UNION ALL '.join(_PAIRS)}) WHERE n > 0 ORDER BY n DESC")
def confusion_pairs(spark, d):
    return metrics.confusion_pairs(_pred(spark, d)).orderBy(F.desc("n"))


_SOURCES = {"from_emo": "substr(sample_id, 1, 3) = 'EMO'", "from_ubm": "substr(sample_id, 1, 3) = 'UBM'", "from_mon": "substr(sample_id, 1, 3) = 'MON'", "unsure": "prob_joy BETWEEN 0.4 AND 0.6"}


@query(f"""WITH r AS (SELECT true_joy = 0 AND pred_joy = 1 AS is_fp, true_joy = 1 AND pred_joy = 0 AS is_fn, {', '.join(f'{v} AS {k}' for k, v in _SOURCES.items())} FROM {P}), l AS ({' UNION ALL '.join(f"SELECT '{k}' AS pattern, is_fp, is_fn, {k} AS shown FROM r" for k in _SOURCES)})
    SELECT pattern, count_if(is_fp AND shown) AS fp, round(100 * count_if(is_fp AND shown) / greatest(count_if(is_fp), 1), 1) AS fp_pct, count_if(is_fn AND shown) AS fn, round(100 * count_if(is_fn AND shown) / greatest(count_if(is_fn), 1), 1) AS fn_pct FROM l GROUP BY pattern""")
def error_summary(spark, d):
    return metrics.error_summary(_pred(spark, d), "joy", {k: F.expr(v) for k, v in _SOURCES.items()})


@query(f"SELECT sample_id, prob_joy FROM (SELECT sample_id, round(prob_joy, 6) AS prob_joy FROM {P} WHERE true_joy = 0 AND pred_joy = 1) ORDER BY sample_id, prob_joy LIMIT 10")
def error_examples(spark, d):
    return metrics.error_rows(_pred(spark, d), "joy", "fp").select("sample_id", F.round("prob_joy", 6).alias("prob_joy")).orderBy("sample_id", "prob_joy").limit(10)


@query(f"""WITH {_LONG}, k AS (SELECT source, label, CASE WHEN y = 0 AND p = 1 THEN 'fp' WHEN y = 1 AND p = 0 THEN 'fn' END AS kind FROM l) SELECT source, label, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY source, label, kind""")
def errors_by_source(spark, d):
    return metrics.errors_by(_pred(spark, d), "source")


@query(f"""WITH c AS (SELECT substr(sample_id, 1, 3) = 'EMO' AS flagged, count(*) AS n, count_if(true_disgust = 1 AND pred_disgust = 1) AS tp, count_if(true_disgust = 0 AND pred_disgust = 1) AS fp, count_if(true_disgust = 1 AND pred_disgust = 0) AS fn FROM {P} GROUP BY 1)
    SELECT flagged, n, round({_PR}, 4) AS precision, round({_RC}, 4) AS recall, round({_F1}, 4) AS f1 FROM c""")
def flag_sensitivity(spark, d):
    return metrics.flag_sensitivity(_pred(spark, d), F.col("source") == "EMO", "disgust")


def _runs_sql() -> str:
    """A metric at several fixed thresholds, as runs."""
    parts = []
    for k, tau in enumerate(_TAUS):
        pooled = " UNION ALL ".join(f"SELECT true_{c} AS y, (prob_{c} >= {tau})::INT AS p FROM {P}" for c in LABELS)
        parts.append(f"SELECT 'tau_{tau}' AS run, {k} AS n, round({S.ratio('2 * count_if(y = 1 AND p = 1)', 'count_if(y = 1) + count_if(p = 1)')}, 4) AS micro_f1 FROM ({pooled})")
    return " UNION ALL ".join(parts)


_TAUS = (0.3, 0.4, 0.5, 0.6, 0.7)


def _runs(spark, d) -> DataFrame:
    rows, out = _pred(spark, d), None
    for k, tau in enumerate(_TAUS):
        one = metrics.overall(thresholds.applied(rows, thresholds.fixed(tau))).select(F.lit(f"tau_{tau}").alias("run"), F.lit(k).alias("n"), "micro_f1")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH r AS ({_runs_sql()}), b AS (SELECT micro_f1 AS base FROM r WHERE run = 'tau_0.5') SELECT run, micro_f1, round(micro_f1 - base, 4) AS delta, CASE WHEN abs(round(micro_f1 - base, 4)) < 0.0005 THEN 'neutral' WHEN micro_f1 > base THEN 'keep' ELSE 'drop' END AS verdict FROM r, b")
def experiment_deltas(spark, d):
    return metrics.compared(_runs(spark, d), "tau_0.5", "micro_f1")


@query(f"WITH r AS ({_runs_sql()}) SELECT run, micro_f1 FROM r ORDER BY micro_f1 DESC, n LIMIT 1")
def best_run(spark, d):
    return metrics.best_run(_runs(spark, d), "micro_f1")


@query(f"WITH r AS ({_runs_sql()}) SELECT 'micro_f1' AS metric, round(avg(micro_f1), 4) AS mean, round(stddev_samp(micro_f1), 4) AS std, count(*) AS n FROM r")
def seed_summary(spark, d):
    return audit.run_summary(_runs(spark, d), ["micro_f1"])


@query(f"WITH r AS ({_runs_sql()}) SELECT 'micro_f1' AS metric, round(avg(micro_f1), 4) AS mean, round(stddev_pop(micro_f1), 4) AS std, count(*) AS n FROM r")
def seed_summary_population(spark, d):
    return audit.run_summary(_runs(spark, d), ["micro_f1"], population=True)


# -- thresholds -----------------------------------------------------------------------------


def _grid(step: float, rounded: bool) -> str:
    marks = thresholds.grid(step, 4 if rounded else None)
    return "g AS (SELECT mark, round(mark, 4) AS tau FROM (SELECT unnest([" + ", ".join(map(repr, marks)) + "]::DOUBLE[]) AS mark))"


def _sweep(step: float, labels=LABELS, rounded: bool = True) -> str:
    return f"""WITH {_grid(step, rounded)}, l AS ({S.long_predictions(labels=labels)}),
    c AS (SELECT label, tau, count_if(y = 1 AND prob >= mark) AS tp, count_if(y = 0 AND prob >= mark) AS fp, count_if(y = 1 AND prob < mark) AS fn FROM l, g GROUP BY label, tau), s AS (SELECT *, {_F1} AS f1 FROM c)"""


def _best(step: float, fallback: float) -> str:
    return f"{_sweep(step, rounded=fallback == thresholds.LOW)}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, tau) AS n FROM s) SELECT label, CASE WHEN f1 > 0 THEN tau ELSE {fallback} END AS tau, round(f1, 6) AS f1 FROM r WHERE n = 1"


@query(_best(0.01, 0.05))
def threshold_sweep(spark, d):
    return thresholds.optimised(_pred(spark, d))


@query(_best(0.001, 0.5))
def threshold_sweep_fine(spark, d):
    return thresholds.swept(_pred(spark, d))


@query(_best(0.005, 0.5))
def threshold_sweep_half(spark, d):
    return thresholds.swept(_pred(spark, d), 0.005)


@query(f"{_sweep(0.005, ('fear',))} SELECT label, tau, tp, fp, fn, round(f1, 6) AS f1 FROM s")
def threshold_curve(spark, d):
    return thresholds.curve(_pred(spark, d), 0.005, ("fear",)).withColumn("f1", F.round("f1", 6))


_SET = {"anger": 0.25, "disgust": 0.35, "fear": 0.55, "joy": 0.5, "sadness": 0.5}


@query(f"SELECT sample_id, {', '.join(f'(prob_{c} >= {_SET.get(c, 0.5)})::INT AS pred_{c}' for c in LABELS)} FROM {P}")
def apply_thresholds(spark, d):
    return thresholds.applied(_pred(spark, d), _SET).select("sample_id", *(f"pred_{c}" for c in LABELS))


_RAISED = thresholds.raised(_SET, {"disgust": 0.05, "fear": 0.05})


@query(f"SELECT sample_id, {', '.join(f'(prob_{c} >= {_RAISED.get(c, 0.5)})::INT AS pred_{c}' for c in LABELS)} FROM {P}")
def raised_thresholds(spark, d):
    return thresholds.applied(_pred(spark, d), _RAISED).select("sample_id", *(f"pred_{c}" for c in LABELS))


@query(f"SELECT sample_id, {', '.join(f'round(0.7 * prob_{c} + 0.3 * (1 - prob_{c}), 6) AS prob_{c}' for c in LABELS)} FROM {P}")
def soft_vote(spark, d):
    rows = _pred(spark, d).select("sample_id", *(F.col(f"prob_{c}").alias(f"one_{c}") for c in LABELS), *((1 - F.col(f"prob_{c}")).alias(f"two_{c}") for c in LABELS))
    return thresholds.blended(rows, "one", "two", 0.7).select("sample_id", *(F.round(f"prob_{c}", 6).alias(f"prob_{c}") for c in LABELS))


@query(f"SELECT sample_id, {', '.join(f'round({chr(49) + chr(32) + chr(45) + chr(32) if k % 2 else chr(32)}prob_{c}, 6) AS prob_{c}' for k, c in enumerate(LABELS))} FROM {P}")
def label_oracle(spark, d):
    rows = _pred(spark, d).select("sample_id", *(F.col(f"prob_{c}").alias(f"one_{c}") for c in LABELS), *((1 - F.col(f"prob_{c}")).alias(f"two_{c}") for c in LABELS))
    return thresholds.picked(rows, {c: ("two", "one")[k % 2 == 0] for k, c in enumerate(LABELS)}).select("sample_id", *(F.round(f"prob_{c}", 6).alias(f"prob_{c}") for c in LABELS))


@query(" UNION ALL ".join(f"SELECT '{c}' AS label, round(min(prob_{c}), 6) AS min, round(avg(prob_{c}), 6) AS mean, round(max(prob_{c}), 6) AS max FROM {P}" for c in LABELS))
def probability_profile(spark, d):
    return thresholds.probability_profile(_pred(spark, d))


def _f1_at(expr) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS label, round({S.ratio('2 * count_if(y = 1 AND p = 1)', 'count_if(y = 1) + count_if(p = 1)')}, 4) AS f1 FROM (SELECT true_{c} AS y, {expr(c)} AS p FROM {P})" for c in LABELS)


@query(f"WITH a AS ({_f1_at(lambda c: f'pred_{c}')}), b AS ({_f1_at(lambda c: f'(prob_{c} >= 0.5)::INT')}) SELECT label, a.f1 AS f1_old, b.f1 AS f1_new, round(b.f1 - a.f1, 4) AS delta, round(b.f1 - a.f1, 4) < -0.01 AS rejected FROM a JOIN b USING (label)")
def regression_guard(spark, d):
    rows = _pred(spark, d)
    return metrics.regressions(metrics.per_label(rows), metrics.per_label(thresholds.applied(rows, thresholds.fixed(0.5))))


@query(f"SELECT sample_id, {', '.join(f'round_even(prob_{c}, 4) AS prob_{c}, pred_{c}, true_{c}' for c in LABELS)} FROM {P}")
def prediction_output(spark, d):
    return _pred(spark, d).select("sample_id", *(x for c in LABELS for x in (F.bround(f"prob_{c}", 4).alias(f"prob_{c}"), f"pred_{c}", f"true_{c}")))


# -- models ----------------------------------------------------------------------------------

def _training(spark, d) -> tuple[DataFrame, DataFrame]:
    """Training rows: those to fit on and those held out, by hash."""
    rows = spread(read(spark, d, "train").select(F.col("sample_id").alias("doc"), "processed_text", *LABELS)).persist()
    held = F.pmod(F.xxhash64("doc"), F.lit(5)) == 0
    return rows.where(~held), rows.where(held)


def _vectors(spark, d, pack: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training rows with vectors of 10,000 word and 15,000 letter terms: fitted
    rows and those held out.  ``pack`` keeps them in memory, for what reads them more than once."""
    fit, rest = _training(spark, d)
    x = tfidf.TfIdf().fit(fit, "doc", "processed_text")
    made = x.vectors(fit, "processed_text"), x.vectors(rest, "processed_text")
    return tuple(map(models.packed, made)) if pack else made


def _probabilities(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(F.col("doc").alias("sample_id"), *(F.round(f"prob_{c}", digits).alias(f"prob_{c}") for c in LABELS))


@query()
def chain_lr(spark, d):
    order = [r.label for r in audit.label_order(_training(spark, d)[0]).orderBy("place").collect()]
    fit, rest = _vectors(spark, d, pack=False)
    return _probabilities(models.Chain(models.logistic(), tuple(order)).fit(fit).predict_proba(rest))


@query()
def chain_cnb(spark, d):
    fit, rest = _vectors(spark, d)
    return _probabilities(models.Chain(models.complement_bayes()).fit(fit).predict_proba(rest))


@query()
def independent_lr(spark, d):
    fit, rest = _vectors(spark, d, pack=False)
    return _probabilities(models.Chain(models.logistic(), chained=False).fit(fit).predict_proba(rest))


@query()
def random_forest(spark, d):
    fit, rest = _vectors(spark, d, pack=False)
    return _probabilities(models.Chain(models.forest(), chained=False).fit(fit).predict_proba(rest))


@query()
def svc_calibrated(spark, d):
    fit, rest = _vectors(spark, d, pack=False)
    for c, model in zip(LABELS, models.fit_calibrated(fit, LABELS)):
        rest = model.predict_proba(rest, "features", f"prob_{c}")
    return _probabilities(rest)


@query()
def sgd_modified_huber(spark, d):
    fit, rest = _vectors(spark, d)
    return _probabilities(models.ModifiedHuber().fit(fit).predict_proba(rest))


@query()
def svd_knn(spark, d):
    """Rows held out, each with the label shares of its five nearest fitted rows in the 200 leading directions."""
    fit, rest = _vectors(spark, d, pack=False)
    table = models.directions(fit, "features", 200)
    key = F.xxhash64("doc").alias("key")
    base, held = (models.reduced(x, "features", table).select(key, "doc", "reduced", *LABELS).persist() for x in (fit, rest))
    got = models.neighbour_shares(held, base, "key", "reduced")
    return held.join(got, F.col("key") == F.col("query")).select(F.col("doc").alias("sample_id"), *(f"prob_{c}" for c in LABELS))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, neighbour) AS place FROM p) SELECT query, neighbour, round(c, 6) AS cosine, place FROM r WHERE place <= 5""")
def nearest_neighbours(spark, d):
    rows = read(spark, d, "embeddings")
    return models.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 5)


@query()
def knn_votes(spark, d):
    """Of the stated queries, the share of each label value among the five nearest rows."""
    rows = read(spark, d, "embeddings")
    near = models.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 5)
    named = near.join(rows.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour")
    return named.groupBy("query", "label").agg((F.count("*") / 5).alias("share"))


@query()
def experiment_runs(spark, d):
    """Two configurations from features to metrics: thresholds on validation rows, test rows measured once."""
    rows = spread(read(spark, d, "train").select("sample_id", "text", "processed_text", *LABELS)).persist()
    part = F.pmod(F.xxhash64("sample_id"), F.lit(10))
    train, val, test = rows.where(part < 7), rows.where((part >= 7) & (part < 9)), rows.where(part == 9)
    configs = [runner.Config("E0_cnb", "E0", "complement_bayes"), runner.Config("E2_lr", "E2", "logistic", chained=False, c=0.5)]
    return runner.run_all(configs, train, val, test)


@query()
def streamed_features(spark, d):
    """Training texts read as a stream, cleaned and scored, and written; what the stream wrote."""
    import tempfile
    import uuid

    from .. import streaming

    base = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()) + f"/stream-{uuid.uuid4().hex}"
    schema = read(spark, d, "train").schema
    source = spark.readStream.schema(schema).format("parquet").load(f"{d}/train.parquet") if _is_folder(spark, f"{d}/train.parquet") else spark.readStream.schema(schema).option("pathGlobFilter", "train.parquet").parquet(d)
    streaming.written(streaming.scored(source.select("sample_id", "text")), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sample_id", "processed_text", "sent_net")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
