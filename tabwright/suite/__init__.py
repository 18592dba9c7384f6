"""Named queries over the driver tables, each with SQL that says what it must return."""

from .base import REGISTRY, oracle_sql, queries  # noqa: F401
from . import (relational, preparing, encoding, windows, profiling, selecting, texting, neighbours,
               modelling, checked_models, sequences)  # noqa: F401
