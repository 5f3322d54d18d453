"""All registered queries."""

from suite import features, files, index, quality, series
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "features", "files", "index", "quality", "series"]
