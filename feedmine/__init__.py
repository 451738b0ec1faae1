"""feedmine: review-feedback mining as Spark DataFrame operators.

Every operator is a function from DataFrames to DataFrames, so one definition
serves a batch job and a Structured Streaming ``foreachBatch``.
"""

from feedmine.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
