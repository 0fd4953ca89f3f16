import pytest
from pyspark.sql import types as T

from tabwise.operators import splits
from tabwise.plans import durations
from tabwise.plans.specs import ColumnSpec, DatasetConfig, FeatureSpec, SplitSpec, TargetSpec, Transform

CONFIG = {
    "dataset": {
        "dataset_id": "pm", "name": "Maintenance", "entity_key": "machine_id", "time_key": "timestamp",
        "columns": {
            "machine_id": {"type": "categorical", "role": "identifier"}, "timestamp": {"type": "timestamp"},
            "kind": {"type": "categorical"}, "value": {"type": "numeric"}, "failure": {"type": "boolean", "role": "event"},
            "mode": {"type": "categorical", "role": "metadata"},
        },
        "split": {"strategy": "Chronological", "train": 0.8, "validation": 0.1, "eval": 0.1},
    },
    "features": {"value": {"transforms": ["current", {"mean": {"windows": ["4w", "13w"]}}]},
                 "kind": {"column": "kind", "transforms": [{"op": "categorical", "min_frequency": 2}]}},
    "target": {"name": "y", "type": "future_event", "source_column": "failure", "horizon": "24h"},
    "search": {"searchable_fields": {"rate": {"field": "value", "aliases": ["speed"]}},
               "semantic_filters": {"hot": {"type": "range_contains", "min_field": "a", "max_field": "b"}}},
}


def test_durations():
    assert durations.seconds("24h") == 86400 and durations.micros("1.5m") == 90_000_000
    for bad in ("", "5y", "xh"):
        with pytest.raises(ValueError):
            durations.seconds(bad)


def test_config_sections_and_json_round_trip():
    config = DatasetConfig.read(CONFIG)
    assert config.dataset.split == SplitSpec("chronological", 0.8, 0.1, 0.1)
    assert config.dataset.keys == ["machine_id", "timestamp"]
    assert config.dataset.dimensions() == ["kind"] and config.dataset.with_role("event") == ["failure"]
    assert config.features.max_history_window() == "13w"
    assert config.target.horizon_micros == 86_400_000_000
    assert config.search.canonical("speed") == "value" and config.search.canonical("other") == "other"
    again = DatasetConfig.from_json(config.raw)
    assert again.features == config.features and again.target == config.target and again.dataset == config.dataset


def test_yaml_file(tmp_path):
    import yaml

    path = tmp_path / "dataset.yaml"
    path.write_text(yaml.safe_dump(CONFIG))
    assert DatasetConfig.load(path).dataset_id == "pm"


def test_transform_spellings():
    assert Transform.read("current") == Transform("current")
    assert Transform.read({"mean": {"windows": ["1h"]}}).windows == ["1h"]
    assert Transform.read({"op": "std", "windows": ["6h"]}).op == "std"
    with pytest.raises(ValueError):
        Transform.read({"a": 1, "b": 2})
    with pytest.raises(TypeError):
        Transform.read(3)


def test_history_is_none_without_windows_and_stages_restrict():
    spec = FeatureSpec.read("d", {"x": {"transforms": ["current"]}, "y": {"transforms": [{"min": {"windows": ["2d"]}}]}})
    assert spec.max_history_window() == "2d" and spec.only("x").max_history_window() is None
    with pytest.raises(ValueError):
        spec.only("z")


def test_rejects_unknown_words():
    with pytest.raises(ValueError):
        ColumnSpec("a", "number")
    with pytest.raises(ValueError):
        ColumnSpec("a", "numeric", "label")
    with pytest.raises(ValueError):
        TargetSpec("y", "ranking", "x")
    with pytest.raises(ValueError):
        SplitSpec("stratified")


def test_physical_types():
    assert ColumnSpec("a", "numeric").accepts(T.DecimalType(10, 2))
    assert not ColumnSpec("a", "numeric").accepts(T.StringType())
    assert ColumnSpec("a", "boolean").accepts(T.LongType()) and ColumnSpec("a", "timestamp").accepts(T.DateType())


def test_split_shares():
    assert splits.resolve_shares(SplitSpec(train=0.7, validation=0.15, test=0.15)) == pytest.approx((0.7, 0.15, 0.15))
    assert splits.resolve_shares(SplitSpec(train=1.0)) == (1.0, 0.0, 0.0)
    assert splits.resolve_shares(SplitSpec(train=1.0), (0.8, 0.2, 0.0)) == pytest.approx((0.8, 0.2, 0.0))
    with pytest.raises(ValueError):
        splits.normalize(0, 0, 0)
