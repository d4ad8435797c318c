"""Named queries over the tables, with the SQL that says the same."""

from . import detect, filters, graphs, intents, records, reports  # noqa: F401  they add to the lists
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
