"""Model training, evaluation and tuning on Spark ML."""

from . import evaluation, learners, summaries, tuning, validation  # noqa: F401
from .learners import fit_model, load_model, model_names  # noqa: F401
