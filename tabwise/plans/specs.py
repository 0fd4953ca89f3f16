"""What a table means: keys, roles, features, label, search vocabulary.

A dataset file is YAML with a ``dataset`` section (or the same keys at top level) and
optional ``features``, ``target`` and ``search`` sections.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

from tabwise.plans import durations

# The vocabulary of a dataset file.
LOGICAL_TYPES = ("numeric", "categorical", "boolean", "timestamp", "string")
ROLES = ("identifier", "feature", "event", "target", "metadata", "ignore")
SPLIT_STRATEGIES = ("chronological", "random")
TARGET_TYPES = ("regression", "classification", "binary", "future_event")

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Spark types each logical type may be stored as.
PHYSICAL_TYPES: dict[str, tuple[type, ...]] = {
    "numeric": (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType),
    "categorical": (T.StringType,),
    "boolean": (T.BooleanType, *_INTEGERS),
    "timestamp": (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType),
    "string": (T.StringType,),
}


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} {value!r} is not one of {', '.join(allowed)}")
    return value


def _mapping(value: Any, what: str) -> Mapping[str, Any]:
    if not isinstance(value, Mapping):
        raise ValueError(f"{what} must be a mapping")
    return value


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    role: str = "feature"
    description: str | None = None

    def __post_init__(self):
        _one_of(self.type, LOGICAL_TYPES, f"type of column {self.name!r}:")
        _one_of(self.role, ROLES, f"role of column {self.name!r}:")

    def accepts(self, physical: T.DataType) -> bool:
        return isinstance(physical, PHYSICAL_TYPES[self.type])


@dataclass(frozen=True)
class SplitSpec:
    strategy: str = "chronological"
    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15

    def __post_init__(self):
        object.__setattr__(self, "strategy", self.strategy.lower())
        _one_of(self.strategy, SPLIT_STRATEGIES, "split strategy")

    @classmethod
    def read(cls, raw: Mapping[str, Any]) -> SplitSpec:
        values = dict(raw)
        if "eval" in values:
            values.setdefault("test", values["eval"])
            del values["eval"]
        known = {k: values[k] for k in ("strategy", "train", "validation", "test") if k in values}
        return cls(**known)


@dataclass(frozen=True)
class DatasetSpec:
    dataset_id: str
    name: str
    entity_key: str
    time_key: str | None = None
    columns: dict[str, ColumnSpec] = field(default_factory=dict)
    split: SplitSpec = field(default_factory=SplitSpec)

    @property
    def temporal(self) -> bool:
        return self.time_key is not None

    @property
    def keys(self) -> list[str]:
        return [self.entity_key] + ([self.time_key] if self.time_key else [])

    def column(self, name: str) -> ColumnSpec:
        try:
            return self.columns[name]
        except KeyError:
            raise KeyError(f"dataset {self.dataset_id!r} declares no column {name!r}") from None

    def with_role(self, role: str) -> list[str]:
        return [c.name for c in self.columns.values() if c.role == role]

    def required_columns(self) -> list[str]:
        return list(self.columns)

    def dimensions(self) -> list[str]:
        """Declared categorical features: the default dimensions of slice discovery."""
        return [c.name for c in self.columns.values() if c.type == "categorical" and c.role == "feature"]

    @classmethod
    def read(cls, raw: Mapping[str, Any]) -> DatasetSpec:
        columns = {
            name: ColumnSpec(name=name, **_mapping(body, f"column {name!r}"))
            for name, body in (raw.get("columns") or {}).items()
        }
        return cls(
            dataset_id=raw["dataset_id"],
            name=raw.get("name", raw["dataset_id"]),
            entity_key=raw["entity_key"],
            time_key=raw.get("time_key"),
            columns=columns,
            split=SplitSpec.read(raw.get("split") or {}),
        )


@dataclass(frozen=True)
class Transform:
    """One entry of a feature's transform list, after reading any of its three spellings."""

    op: str
    params: tuple[tuple[str, Any], ...] = ()

    def get(self, name: str, default: Any = None) -> Any:
        return dict(self.params).get(name, default)

    @property
    def windows(self) -> list[str]:
        return list(self.get("windows") or [])

    @classmethod
    def read(cls, raw: Any) -> Transform:
        """Accepts ``name``, ``{name: settings}`` and ``{op: name, **settings}``."""
        match raw:
            case str(name):
                settings: Mapping[str, Any] = {}
            case {"op": name, **settings}:
                pass
            case Mapping():
                name, *others = raw
                if others:
                    raise ValueError(f"one operation per transform, not {[name, *others]}")
                settings = raw[name] if isinstance(raw[name], Mapping) else {}
            case _:
                raise TypeError(f"cannot read a transform from {raw!r}")
        frozen = {k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()}
        return cls(name, tuple(sorted(frozen.items())))


@dataclass(frozen=True)
class FeatureSource:
    column: str
    transforms: tuple[Transform, ...]


@dataclass(frozen=True)
class FeatureSpec:
    dataset_id: str
    features: dict[str, FeatureSource] = field(default_factory=dict)

    def items(self):
        for source in self.features.values():
            for transform in source.transforms:
                yield source.column, transform

    def source_columns(self) -> list[str]:
        return list(dict.fromkeys(s.column for s in self.features.values()))

    def windows(self) -> list[str]:
        from tabwise.operators.features import needs_history

        return [w for _, t in self.items() if needs_history(t.op) for w in t.windows]

    def max_history_window(self) -> str | None:
        """Longest trailing window, or None when no transform looks back."""
        return max(self.windows(), key=durations.micros, default=None)

    @classmethod
    def read(cls, dataset_id: str, raw: Mapping[str, Any]) -> FeatureSpec:
        features = {}
        for name, body in raw.items():
            body = _mapping(body, f"feature {name!r}")
            transforms = tuple(Transform.read(t) for t in body.get("transforms") or [])
            features[name] = FeatureSource(body.get("column", name), transforms)
        return cls(dataset_id, features)

    def only(self, *names: str) -> FeatureSpec:
        """Stage restriction: the same table with fewer model inputs."""
        unknown = [n for n in names if n not in self.features]
        if unknown:
            raise ValueError(f"no such features: {unknown}")
        return replace(self, features={n: self.features[n] for n in names})


@dataclass(frozen=True)
class TargetSpec:
    name: str
    type: str
    source_column: str
    horizon: str | None = None
    positive_class: Any = 1

    def __post_init__(self):
        _one_of(self.type, TARGET_TYPES, "target type")

    @property
    def is_regression(self) -> bool:
        return self.type == "regression"

    @property
    def horizon_micros(self) -> int | None:
        return durations.micros(self.horizon) if self.horizon else None


def _entries(raw: Mapping[str, Any], section: str, kind: type, **own_name: None) -> dict[str, Any]:
    """Named entries of a section as dataclasses; lists become tuples, absent settings keep their defaults.

    A setting in ``own_name`` that is absent takes the entry's name.
    """
    known, out = {f.name for f in fields(kind)}, {}
    for name, body in (raw.get(section) or {}).items():
        body = _mapping(body, f"{section} entry {name!r}")
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in body.items() if k in known and v is not None}
        out[name] = kind(**(dict.fromkeys(own_name, name) | given | {"name": name}))
    return out


@dataclass(frozen=True)
class SearchField:
    name: str
    field: str
    operators: tuple[str, ...] = ("eq", "in")
    unit: str | None = None
    aliases: tuple[str, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class SemanticFilter:
    name: str
    type: str
    min_field: str | None = None
    max_field: str | None = None
    expands_to: tuple[Mapping[str, Any], ...] = ()
    unit: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class SearchSpec:
    fields: dict[str, SearchField] = field(default_factory=dict)
    semantics: dict[str, SemanticFilter] = field(default_factory=dict)

    def canonical(self, name: str) -> str:
        """Column behind a field name or one of its aliases; other names pass through."""
        for entry in self.fields.values():
            if name == entry.name or name in entry.aliases:
                return entry.field
        return name

    @classmethod
    def read(cls, raw: Mapping[str, Any]) -> SearchSpec:
        return cls(_entries(raw, "searchable_fields", SearchField, field=None),
                   _entries(raw, "semantic_filters", SemanticFilter))


@dataclass(frozen=True)
class DatasetConfig:
    dataset: DatasetSpec
    features: FeatureSpec | None = None
    target: TargetSpec | None = None
    search: SearchSpec | None = None
    raw: str = ""

    @property
    def dataset_id(self) -> str:
        return self.dataset.dataset_id

    @classmethod
    def read(cls, raw: Mapping[str, Any]) -> DatasetConfig:
        raw = _mapping(raw, "a dataset file")
        dataset = DatasetSpec.read(raw.get("dataset", raw))
        return cls(
            dataset=dataset,
            features=FeatureSpec.read(dataset.dataset_id, raw["features"]) if raw.get("features") else None,
            target=TargetSpec(**raw["target"]) if raw.get("target") else None,
            search=SearchSpec.read(raw["search"]) if raw.get("search") else None,
            raw=json.dumps(raw, default=str),
        )

    @classmethod
    def load(cls, path: str | Path) -> DatasetConfig:
        return cls.read(yaml.safe_load(Path(path).read_text()))

    @classmethod
    def from_json(cls, text: str) -> DatasetConfig:
        return cls.read(json.loads(text))
