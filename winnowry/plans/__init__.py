"""All queries that apply the operators to the tables, with their SQL."""

from . import choice, measure, records, runs, scalar
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "choice", "measure", "records", "runs", "scalar"]
