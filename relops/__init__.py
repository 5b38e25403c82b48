"""Release-oriented table maintenance on Spark DataFrames."""

from relops.session import get_spark

__all__ = ["get_spark"]
