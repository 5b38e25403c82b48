"""Queries over the driver tables, one or more per operator."""

from relops.workload import functions, incremental, registry, storage  # noqa: F401
from relops.workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
