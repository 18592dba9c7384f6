"""Profiles, data expectations, drift and the statistics behind them."""

from . import advice, aggregates, correlations, drift, expectations, monitoring, profile, temporal  # noqa: F401
