"""The registered queries: one per operator, each with the SQL it must agree with."""

from tabwise.queries import analysis, attribution, labels, models, profiles, ranking, search, series, sources, splits, streams, windows
from tabwise.queries.registry import REGISTRY

__all__ = ["REGISTRY", "analysis", "attribution", "labels", "models", "profiles", "ranking", "search", "series",
           "sources", "splits", "streams", "windows"]
