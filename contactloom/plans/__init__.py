"""Registered queries of the engine, each with a DuckDB statement where SQL can express it."""

from . import chains, features, matrices, pairs_bins, text  # noqa: F401
