"""tabwright: fitted table operators, profiles, drift reports and models on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# task code travels with its closure, so executors need no installed copy of the package
register_pickle_by_value(sys.modules[__name__])

from .core import (Operator, Splits, apply, artifact_from_json, artifact_to_json, fit,
                   fit_apply, get_operator, operator, operator_names)
from . import functions, operators, profiling, models, plans, sources, streaming  # noqa: F401,E402

__all__ = ["Operator", "Splits", "apply", "artifact_from_json", "artifact_to_json", "fit",
           "fit_apply", "get_operator", "operator", "operator_names"]
