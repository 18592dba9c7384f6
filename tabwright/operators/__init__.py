"""Fitted table operators; importing this package fills the registry."""

from . import (cleaning, encoding, features, imputation, outliers, binning, resampling, rows,
               scaling, selection, splitting, text, timeseries, inspection)  # noqa: F401
