"""Experiments: features, a model, thresholds found on validation rows, metrics.

Rows that thresholds are found on are never those that a model is fitted on,
and test rows are only measured."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from ..schema import LABELS
from . import metrics, thresholds
from .compose import extractor
from .models import Chain, complement_bayes, logistic, packed


@dataclass(frozen=True)
class Config:
    name: str
    features: str = "E0"
    model: str = "logistic"
    order: tuple[str, ...] = LABELS
    chained: bool = True
    c: float = 1.0
    weight: str | float | None = "balanced"
    max_iter: int = 100
    sweep: str = "coarse"  # coarse, fine, or fixed
    settings: dict = field(default_factory=dict)


def factory(config: Config):
    if config.model == "logistic":
        return logistic(config.c, config.weight, config.max_iter)
    if config.model == "complement_bayes":
        return complement_bayes()
    if config.model == "forest":
        from .models import forest

        return forest(**config.settings.get("forest", {}))
    raise ValueError(f"unknown model {config.model!r}")


def found_thresholds(df: DataFrame, how: str) -> dict[str, float]:
    if how == "fixed":
        return thresholds.fixed()
    got = thresholds.optimised(df) if how == "coarse" else thresholds.swept(df)
    return {r.label: r.tau for r in got.collect()}


def run(config: Config, train: DataFrame, val: DataFrame, test: DataFrame | None = None, doc: str = "sample_id", raw: str = "text", clean: str = "processed_text") -> DataFrame:
    """(run, part, n, macro_f1, …): metrics on validation and, if given, test rows."""
    x = extractor(config.features, **{k: v for k, v in config.settings.items() if k != "forest"}).fit(train, doc, raw, clean)
    made, rows = factory(config), x.transform(train, doc, raw, clean)
    chain = Chain(made, config.order, config.chained).fit(rows if hasattr(made, "together") else packed(rows))
    parts, taus = [], None
    for part, rows in (("val", val), ("test", test)):
        if rows is None:
            continue
        scored = chain.predict_proba(x.transform(rows, doc, raw, clean)).withColumnsRenamed({c: f"true_{c}" for c in LABELS})
        scored = packed(scored.select("*"))
        with_pred = scored.withColumns({f"pred_{c}": F.lit(0) for c in LABELS})
        taus = taus or found_thresholds(with_pred, config.sweep)
        parts.append(metrics.overall(thresholds.applied(scored, taus)).select(F.lit(config.name).alias("run"), F.lit(part).alias("part"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_all(configs: list[Config], *tables: DataFrame, **kw) -> DataFrame:
    out = None
    for config in configs:
        one = run(config, *tables, **kw)
        out = one if out is None else out.unionByName(one)
    return out


def strength_sweep(base: Config, strengths: tuple[float, ...]) -> list[Config]:
    return [replace(base, name=f"{base.name}_C{c:g}", c=c) for c in strengths]


def order_sweep(base: Config, orders: dict[str, list[str]]) -> list[Config]:
    return [replace(base, name=f"{base.name}_{k}", order=tuple(v)) for k, v in orders.items()]


def weight_sweep(base: Config, weights: tuple = (None, 1.5, 2.0, 3.0, "balanced")) -> list[Config]:
    return [replace(base, name=f"{base.name}_w{w}", weight=w) for w in weights]
