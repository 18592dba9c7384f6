"""Stream forms of batch operators; each equals its batch form on the same rows."""

from .streams import drift_batches, hourly_counts, transform_stream

__all__ = ["drift_batches", "hourly_counts", "transform_stream"]
