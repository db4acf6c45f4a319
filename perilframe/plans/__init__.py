"""Bindings of every operator to the given tables."""

from . import (bind_aggregates, bind_columns, bind_evaluation, bind_metrics, bind_models, bind_series, bind_sources,  # noqa: F401
               bind_windows)
from .registry import ORACLES, QUERIES  # noqa: F401
