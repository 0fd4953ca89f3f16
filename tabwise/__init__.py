"""Predictive analytics over tables and entity time series, as Spark DataFrames.

Every public function takes and returns lazy DataFrames (plus a spec where the
meaning of columns matters); nothing here collects data-sized results.
"""

__version__ = "0.1.0"
