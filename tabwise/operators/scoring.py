"""Batch scoring: as of a time, by entity, of given records, and search → score → rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.functions import scalars
from tabwise.operators import features, joins, metrics
from tabwise.operators import filters as flt
from tabwise.operators import search as srch
from tabwise.operators.models import TrainedModel
from tabwise.plans import durations
from tabwise.plans.specs import DatasetConfig
from tabwise.session import settle

ERROR = "prediction_error"


def features_as_of(
    config: DatasetConfig, fitted: features.FittedFeatures | None, observations: DataFrame, as_of=None,
    layout: lay.Layout | None = None,
) -> DataFrame:
    """Feature rows at every entity's last observation at or before one time (default: the latest).

    The latest time of every entity comes from one map-side combined pass. The earliest of them less the longest
    window bounds the second scan, and only rows inside the window before an entity's own latest time are windowed.
    """
    spec, rows = config.dataset, observations
    if not spec.temporal:
        return features.build_features(rows, spec, config.features, fitted)[0]
    if as_of is not None:
        bound = F.lit(as_of).cast("timestamp").cast(rows.schema[spec.time_key].dataType)
        rows = rows.where(F.col(spec.time_key) <= bound)
    history = config.features.max_history_window()
    needs_start = any(t.op == "elapsed_time" for _, t in config.features.items())
    if not needs_start:
        span = durations.micros(history) if history else 1
        rows = recent_history(rows, spec.entity_key, spec.time_key, span)
    built, _ = features.build_features(rows, spec, config.features, fitted, layout=layout)
    return joins.latest_per_entity(built, spec.entity_key, spec.time_key)


def recent_history(rows: DataFrame, entity: str, time: str, span: int) -> DataFrame:
    """Rows less than ``span`` microseconds before their entity's latest time; rows without a time are left out."""
    ends = settle(rows.groupBy(F.col(entity).alias("__of")).agg(F.max(time).alias("__end")))
    earliest = ends.agg(F.min("__end")).first()[0]
    if earliest is None:
        return rows.where(F.lit(False))
    kind = rows.schema[time].dataType
    bound = scalars.shift_time(F.lit(earliest).cast("timestamp"), -span).cast(kind)
    joined = rows.where(F.col(time) >= bound).join(ends, F.col(entity).eqNullSafe(F.col("__of")))
    return joined.where(scalars.micros(time) > scalars.micros("__end") - F.lit(span)).drop("__of", "__end")


def score_as_of(
    model: TrainedModel, observations: DataFrame, as_of=None, layout: lay.Layout | None = None
) -> DataFrame:
    """One prediction per entity as of one time."""
    keys = model.config.dataset.keys
    scored = model.transform(features_as_of(model.config, model.fitted, observations, as_of, layout))
    return scored.select(*keys, *_outputs(model))


def asked_history(
    config: DatasetConfig, observations: DataFrame, requests: DataFrame, request_time: str, layout: lay.Layout | None = None
) -> DataFrame:
    """Observations that some request can see: those in the longest window before the one it is answered from.

    A first pass over keys and times alone finds, for every request, the time of its latest observation. The windows before
    these times, united per entity, say which rows are read; the earliest and latest of them bound the scan.
    """
    spec = config.dataset
    entity, time, kind = spec.entity_key, spec.time_key, observations.schema[spec.time_key].dataType
    latest = requests.agg(F.max(F.col(request_time).cast("timestamp"))).first()[0]
    if latest is None:
        return observations.where(F.lit(False))
    observations = observations.where(F.col(time) <= F.lit(latest).cast(kind))
    wanted = requests.select(entity, request_time).distinct()
    asked = wanted.select(F.col(entity).alias("__asked")).distinct()
    of_asked = lambda rows: rows.join(asked, F.col(entity) == F.col("__asked"), "left_semi")
    if any(t.op == "elapsed_time" for _, t in config.features.items()):
        return of_asked(observations)  # needs every entity's first row
    times = of_asked(observations.select(entity, time)).distinct()
    seen = joins.as_of_join(wanted, times, entity, request_time, time, prefix="f_", layout=layout)
    ends = settle(seen.select(F.col(entity).alias("__of"), scalars.micros(f"f_{time}").alias("__end")).where(
        F.col("__end").isNotNull()).distinct())
    earliest = ends.agg(F.min("__end")).first()[0]
    if earliest is None:
        return observations.where(F.lit(False))
    history = config.features.max_history_window()
    span = durations.micros(history) if history else 1
    # Windows that touch become one interval; an interval is dealt in pieces of a window's length, which are join keys.
    order = Window.partitionBy("__of").orderBy("__end")
    fresh = F.col("__end") - F.lag("__end").over(order) > span
    numbered = ends.withColumn("__run", F.sum(F.coalesce(fresh.cast("int"), F.lit(1))).over(order))
    runs = numbered.groupBy("__of", "__run").agg((F.min("__end") - span).alias("__after"), F.max("__end").alias("__upto"))
    slot = lambda us: F.floor(us / F.lit(span)).cast("long")
    pieces = runs.select("__of", "__after", "__upto", F.explode(F.sequence(slot(F.col("__after")), slot(F.col("__upto")))).alias("__slot"))
    bound = scalars.from_micros(F.lit(earliest - span)).cast(kind)
    us = scalars.micros(time)
    return observations.where(F.col(time) > bound).join(
        pieces, (F.col(entity) == F.col("__of")) & (slot(us) == F.col("__slot")) & (us > F.col("__after")) & (us <= F.col("__upto")),
        "left_semi")


def score_requests(
    model: TrainedModel, observations: DataFrame, requests: DataFrame, request_time: str = "as_of",
    layout: lay.Layout | None = None,
) -> DataFrame:
    """Score many (entity, time) requests in one job; requests without history carry an error text."""
    spec = model.config.dataset
    observations = asked_history(model.config, observations, requests, request_time, layout)
    built, _ = features.build_features(observations, spec, model.config.features, model.fitted, layout=layout)
    found = joins.as_of_join(
        requests, built.withColumn("__seen", F.lit(1)), spec.entity_key, request_time, spec.time_key,
        prefix="f_", layout=layout,
    )
    names = {f"f_{n}": n for n in model.feature_names}
    flat = found.select(
        *requests.columns, F.col(f"f_{spec.time_key}").alias("observed_at"), F.col("f___seen").alias("__seen"),
        *[scalars.named(k).alias(v) for k, v in names.items()],
    )
    scored = model.transform(flat)
    seen = F.col("__seen").isNotNull()
    missing = F.concat(
        F.lit("no observation of entity "), F.coalesce(F.col(spec.entity_key).cast("string"), F.lit("null")),
        F.lit(" at or before "), F.coalesce(F.col(request_time).cast("string"), F.lit("null")),
    )
    return scored.select(
        *requests.columns, "observed_at", *[F.when(seen, F.col(c)).alias(c) for c in _outputs(model)],
        F.when(~seen, missing).alias(ERROR),
    )


def score_entities(model: TrainedModel, table: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Score entities of a table: the latest row of each where it has a time key, else its row."""
    spec = model.config.dataset
    rows = table if entities is None else table.join(entities.select(spec.entity_key).distinct(), spec.entity_key, "left_semi")
    if spec.temporal:
        return score_as_of(model, rows)
    built, _ = features.build_features(rows, spec, model.config.features, model.fitted)
    return model.transform(built).select(spec.entity_key, *_outputs(model))


def score_records(model: TrainedModel, records: DataFrame) -> DataFrame:
    """Score given rows; key columns may be absent, but only features without history are possible."""
    config, spec = model.config, model.config.dataset
    back = config.features.max_history_window()
    if back is not None:
        raise ValueError(f"features look back {back}; score entities as of a time instead of single records")
    absent = [c for c in config.features.source_columns() if c not in records.columns]
    if absent:
        raise ValueError(f"records lack the source columns {absent}")
    rows = with_placeholder_keys(records, spec)
    built, _ = features.build_features(rows, spec, config.features, model.fitted, keep=records.columns)
    return model.transform(built).select(*map(scalars.named, records.columns), *_outputs(model))


def with_placeholder_keys(records: DataFrame, spec) -> DataFrame:
    if spec.entity_key not in records.columns:
        records = records.withColumn(spec.entity_key, F.lit("__record__"))
    if spec.time_key and spec.time_key not in records.columns:
        records = records.withColumn(spec.time_key, F.to_timestamp(F.lit("2000-01-01 00:00:00")))
    return records


def _outputs(model: TrainedModel) -> list[str]:
    return ["prediction"] if model.regression else ["prediction", "predicted_label"]


@dataclass(frozen=True)
class RankedSearch:
    rows: DataFrame
    applied: list[dict[str, Any]]
    matching: DataFrame


def rank_search(
    catalog: DataFrame, scores: DataFrame, entity: str, filters=None, sort=None, limit: int = 50,
    columns: Sequence[str] | None = None, spec=None, threshold: float | None = None,
    rank_before_limit: bool = False, tie_break: Sequence[str] = (),
) -> RankedSearch:
    """Search a catalogue, attach each entity's prediction, order by it (missing last).

    The limit applies to the search by default; ``rank_before_limit`` ranks every match and then limits.
    With a threshold the label is ``risk`` at or above it and ``safe`` below.
    """
    shown = list(columns or catalog.columns)
    wanted = list(dict.fromkeys([entity, *shown]))
    value = scores.select(F.col(entity).alias("__e"), "prediction")
    if rank_before_limit:
        concrete = flt.expand(flt.normalize(filters), spec)
        matching = flt.apply(catalog, concrete)
        flt.check_columns(catalog, wanted, "columns")
        rows, applied = matching.select(*wanted), [f.audit() for f in concrete]
    else:
        found = srch.search(catalog, filters, sort, limit, wanted, spec, tie_break=tie_break or [entity])
        rows, applied, matching = found.rows, found.applied, found.matching
    joined = rows.join(value, F.col(entity) == F.col("__e"), "left").drop("__e")
    joined = joined.withColumn(
        ERROR, F.when(F.col("prediction").isNull(), F.lit("no prediction for this entity"))
    )
    if threshold is not None:
        p = F.col("prediction")
        joined = joined.withColumn(
            "prediction_label", F.when(p >= F.lit(threshold), F.lit("risk")).when(p.isNotNull(), F.lit("safe"))
        )
    ranked = joined.orderBy(F.desc_nulls_last("prediction"), F.asc(entity))
    if rank_before_limit:
        ranked = ranked.limit(srch.clamp_limit(limit))
    return RankedSearch(ranked, applied, matching)


def search_and_predict(
    catalog: DataFrame, model: TrainedModel, observations: DataFrame, as_of=None, layout=None, **search_args
) -> RankedSearch:
    """Search, predict every match as of one time with the model, rank by prediction.

    Only observations of entities that match the search are read into windows.
    """
    entity = model.config.dataset.entity_key
    wanted = flt.expand(flt.normalize(search_args.get("filters")), search_args.get("spec"))
    matches = flt.apply(catalog, wanted).select(F.col(entity).alias("__match")).distinct()
    observations = observations.join(matches, F.col(entity) == F.col("__match"), "left_semi")
    scores = score_as_of(model, observations, as_of, layout)
    threshold = None if model.regression else model.threshold
    return rank_search(catalog, scores, model.config.dataset.entity_key, threshold=threshold, **search_args)


def staged_scores(stages: Mapping[str, DataFrame], entity: str) -> DataFrame:
    """Predictions of several models side by side, one column per stage."""
    parts = [s.select(entity, F.lit(n).alias("__stage"), "prediction") for n, s in stages.items()]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    # One shuffle for any number of stages.
    return both.groupBy(entity).agg(*[
        F.max(F.when(F.col("__stage") == n, F.col("prediction"))).alias(n) for n in stages
    ])


@dataclass(frozen=True)
class Evaluation:
    overall: DataFrame
    filtered: DataFrame | None
    sample: DataFrame
    scored: DataFrame


def score_held_out(
    model: TrainedModel, table: DataFrame, split: str | None = "split", layout=None, cold_start: bool = False
) -> DataFrame:
    """Held-out rows with label and prediction beside the table's own columns.

    Predictions stay on their row, so filters and error slices always see the right one. Windows read the full
    history before the held-out rows unless ``cold_start``. Metrics read the result many times, so it is
    written once.
    """
    from tabwise.operators.models import labelled_features

    config, label = model.config, model.config.target.name
    held_out = (lambda d: d.where(F.col(split) == "evaluation")) if split else (lambda d: d)
    source = held_out(table) if cold_start else table
    built, _ = labelled_features(
        source, config, layout, fitted=model.fitted, keep=[c for c in table.columns if c != label]
    )
    scored = model.transform(held_out(built).where(F.col(label).isNotNull()))
    return settle(scored.drop(*[n for n in model.feature_names if n not in table.columns]))


def evaluate(
    model: TrainedModel, table: DataFrame, split: str | None = "split", filters=None, sample_size: int = 50,
    layout=None, cold_start: bool = False,
) -> Evaluation:
    """Held-out metrics, overall and under an optional filter, with the first 1 to 1000 scored rows in key order."""
    config, label = model.config, model.config.target.name
    scored = score_held_out(model, table, split, layout, cold_start)

    def measured(rows: DataFrame) -> DataFrame:
        if not model.regression:
            return metrics.evaluate_binary(rows, label, "prediction", model.threshold)
        mean = rows.agg(F.avg(label)).first()[0]  # the constant predictor of the evaluated rows
        return metrics.evaluate_regression(rows, label, "prediction", mean)

    chosen = scored
    filtered = None
    if filters:
        chosen = flt.matching(scored, filters)
        if chosen.isEmpty():
            raise ValueError("no held-out rows match the filters")
        filtered = measured(chosen)
    if model.regression:
        sample = metrics.with_regression_errors(chosen, label, "prediction").drop("pct_error")
    else:
        sample = chosen
    shown = [*config.dataset.keys, F.col(label).alias("actual"), F.col("prediction").alias("predicted")]
    shown += [c for c in ("error", "abs_error", "predicted_label") if c in sample.columns]
    return Evaluation(measured(scored), filtered, sample.orderBy(*config.dataset.keys).select(*shown).limit(srch.clamp_limit(sample_size)), scored)
