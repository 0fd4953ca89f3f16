"""Feature engineering: trailing time windows, calendar, one-hot, pass-through.

A window of length w at time t holds the entity's rows with time in ``(t - w, t]``, so nothing
after t is ever used. Feature names are part of the contract: ``{column}_{op}_{window}``.
A new transform is one entry in ``TRANSFORMS``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.functions import scalars
from tabwise.operators import dense_windows, encoding
from tabwise.plans import durations
from tabwise.plans.specs import DatasetSpec, FeatureSpec, Transform

US = "__us"


@dataclass
class FittedFeatures:
    """State learned on the training rows; scoring applies it and never refits."""

    categories: dict[str, list[str]] = field(default_factory=dict)
    feature_names: list[str] = field(default_factory=list)
    #: Categorical columns that are carried as one category index.
    sparse: list[str] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return {"categories": self.categories, "feature_names": self.feature_names, "sparse": self.sparse}

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> FittedFeatures:
        return cls(dict(raw.get("categories", {})), list(raw.get("feature_names", [])), list(raw.get("sparse", [])))

    @property
    def sparse_features(self) -> dict[str, list[str]]:
        """Per index column, the names of the features it stands for."""
        return {encoding.sparse_name(c): [scalars.onehot_name(c, v) for v in self.categories[c]] for c in self.sparse}

    @property
    def expanded_names(self) -> list[str]:
        """One name per feature of the vector."""
        held = self.sparse_features
        return [f for n in self.feature_names for f in held.get(n, [n])]


@dataclass(frozen=True)
class Context:
    """What a transform may use to build its columns."""

    spec: DatasetSpec
    fitted: FittedFeatures
    frame: Callable[[str], Any]


Built = list[tuple[str, Column]]


@dataclass(frozen=True)
class TransformRule:
    build: Callable[[Context, str, Transform], Built]
    needs_history: bool = False


def _windowed(op: str, formula: Callable[[str, Any], Column]) -> TransformRule:
    def build(ctx: Context, column: str, t: Transform) -> Built:
        return [(f"{column}_{op}_{w}", formula(column, ctx.frame(w))) for w in t.windows]

    return TransformRule(build, needs_history=True)


def slope_columns(column: str, frame, unbiased: bool = False) -> Column:
    """Trend per second: population covariance over sample variance of time.

    Time and value means are taken over their own non-null rows, so the covariance carries the
    difference between the mean time of the valued rows and of all rows. ``unbiased`` gives the
    least-squares slope instead.
    """
    t, y = F.col("__t"), F.col(column).cast("double")
    if unbiased:
        return F.regr_slope(y, t).over(frame)
    shift = F.avg(F.when(y.isNotNull(), t)).over(frame) - F.avg(t).over(frame)
    covariance = F.covar_pop(t, y).over(frame) + shift * F.avg(y).over(frame)
    variance = F.var_samp(t).over(frame)
    return F.when(variance > 0, covariance / variance)


def _calendar(name: str, formula: Callable[[Column], Column]) -> TransformRule:
    return TransformRule(lambda ctx, _column, _t: [(name, formula(F.col(ctx.spec.time_key)))])


def _categorical(ctx: Context, column: str, t: Transform) -> Built:
    if column not in ctx.fitted.categories:
        raise ValueError(f"no categories learned for {column!r}; fit the features on training rows first")
    if column in ctx.fitted.sparse:
        name = encoding.sparse_name(column)
        return [(name, scalars.named(name))]
    return encoding.onehot(column, ctx.fitted.categories[column])


TRANSFORMS: dict[str, TransformRule] = {
    "current": TransformRule(lambda _ctx, c, _t: [(f"{c}_current", scalars.named(c))]),
    "mean": _windowed("mean", lambda c, f: F.avg(c).over(f)),
    "min": _windowed("min", lambda c, f: F.min(c).over(f)),
    "max": _windowed("max", lambda c, f: F.max(c).over(f)),
    "std": _windowed("std", lambda c, f: F.stddev_samp(c).over(f)),
    "median": _windowed("median", lambda c, f: F.percentile(c, 0.5).over(f)),
    "slope": _windowed("slope", slope_columns),
    "delta": _windowed("delta", lambda c, f: F.col(c) - F.min(c).over(f)),
    "hour_of_day": _calendar("hour_of_day", scalars.hour_of_day),
    "day_of_week": _calendar("day_of_week", scalars.day_of_week),
    "elapsed_time": TransformRule(
        lambda ctx, _c, _t: [
            ("elapsed_time", F.expr(f"div({US} - __first, 1000000)").cast("double"))
        ]
    ),
    "categorical": TransformRule(_categorical),
}


def needs_history(op: str) -> bool:
    return op in TRANSFORMS and TRANSFORMS[op].needs_history


def _check(spec: FeatureSpec) -> None:
    for _, t in spec.items():
        if t.op not in TRANSFORMS:
            raise ValueError(f"unsupported transform {t.op!r}; use one of {', '.join(TRANSFORMS)}")


def fit_features(
    train: DataFrame, spec: FeatureSpec, max_categories: int | None = encoding.MAX_CATEGORIES,
    sparse_from: int | None = None,
) -> FittedFeatures:
    """Learn categories from the training rows only; columns with more than ``sparse_from`` of them stay one index."""
    _check(spec)
    minimum = {c: t.get("min_frequency", 1) for c, t in spec.items() if t.op == "categorical"}
    categories = encoding.fit_categories(train, minimum, max_categories)
    wide = [c for c, values in categories.items() if sparse_from is not None and len(values) > sparse_from]
    return FittedFeatures(categories, sparse=wide)


def build_features(
    df: DataFrame,
    dataset: DatasetSpec,
    spec: FeatureSpec,
    fitted: FittedFeatures | None = None,
    keep: Sequence[str] = (),
    layout: lay.Layout | None = None,
    frame_rows: int | None = None,
) -> tuple[DataFrame, FittedFeatures]:
    """Keys, ``keep`` columns and every engineered feature, one output row per input row.

    All windows share one shuffle and one sort per entity (or entity and time bucket when an entity
    is too heavy for a task). Entities with more than ``frame_rows`` rows in a window (by default what
    ``dense_windows`` takes) go through merged partial moments.
    """
    _check(spec)
    limit = {} if frame_rows is None else {"frame_rows": frame_rows}
    fitted = fitted or FittedFeatures()
    looking_back = [(c, t.op, w) for c, t in spec.items() if needs_history(t.op) for w in t.windows]
    if looking_back and not dataset.temporal:
        raise ValueError(f"transforms of {spec.source_columns()} need a time key")
    started = any(t.op == "elapsed_time" for _, t in spec.items())
    if not (looking_back or started):
        return select_features(df, dataset, spec, fitted, keep, {})
    work = df.withColumn(US, scalars.micros(dataset.time_key))
    entity = dataset.entity_key
    plan = lay.resolve(layout, work, [entity], F.col(US))
    if dense_windows.choose(looking_back, plan, **limit):
        dense = dense_windows.dense_entities(work, entity, US, looking_back, **limit)
        same = F.col(entity).eqNullSafe(F.col("__de"))
        sparse = work.join(dense, same, "left_anti")
        rest = lay.measure(sparse, [entity], F.col(US))
        a, state = _windowed_features(sparse, dataset, spec, fitted, keep, looking_back, rest, None)
        b, _ = _windowed_features(
            work.join(dense, same, "left_semi"), dataset, spec, fitted, keep, looking_back, plan, limit
        )
        return a.unionByName(b), state
    return _windowed_features(work, dataset, spec, fitted, keep, looking_back, plan, limit)


def _windowed_features(work, dataset, spec, fitted, keep, looking_back, plan: lay.Layout, merged: dict | None):
    """``merged`` holds the limit above which windows take merged moments; None keeps sliding frames."""
    entity = dataset.entity_key
    if any(t.op in ("elapsed_time", "slope") for _, t in spec.items()):
        work = lay.with_extreme(work, entity, US, "__first", latest=False, layout=plan)
        work = work.withColumn("__t", F.expr(f"div({US} - __first, 1000000)"))
    dense: dict[str, str] = {}
    if merged is not None:
        work, dense = dense_windows.attach(work, entity, US, looking_back, plan, **merged)
    framed = [durations.micros(w) for c, op, w in looking_back if f"{c}_{op}_{w}" not in dense]
    if framed:
        span = max(framed)
        work = lay.range_halo(work, F.col(US), plan.at_least(span), before=span - 1)
    return select_features(work, dataset, spec, fitted, keep, dense, halo=bool(framed))


def select_features(work, dataset, spec, fitted, keep, dense: dict[str, str], halo: bool = False):
    """Keys, kept columns and features; ``dense`` names the columns that already hold a feature."""
    def frame(window: str):
        parts = [dataset.entity_key] + ([lay.BUCKET] if halo else [])
        return Window.partitionBy(*parts).orderBy(US).rangeBetween(-durations.micros(window) + 1, 0)

    for column in fitted.sparse:
        work = encoding.with_category_index(work, column, fitted.categories[column], encoding.sparse_name(column))
    ctx = Context(dataset, fitted, frame)
    built: Built = []
    for column, t in spec.items():
        for name, value in TRANSFORMS[t.op].build(ctx, column, t):
            built.append((name, F.col(dense[name]) if name in dense else value))
    names = [name for name, _ in built]
    carried = list(dict.fromkeys([*dataset.keys, *keep]))
    extra = [lay.OWN, lay.BUCKET] if halo else []
    out = work.select(*map(scalars.named, carried), *extra, *[value.alias(name) for name, value in built])
    return (lay.owned(out) if halo else out), FittedFeatures(fitted.categories, names, fitted.sparse)
