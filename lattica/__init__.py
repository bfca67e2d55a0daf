"""Property-graph analytics on Spark DataFrames.

A graph is a pair of DataFrames: ``nodes`` (typed declarations) and ``edges`` (typed
relations with their sites and a confidence). Everything else is a function from
DataFrames to DataFrames.
"""

from .schema import Graph

__all__ = ["Graph"]
