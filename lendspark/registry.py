"""All queries of the credit-portfolio part and their DuckDB oracles."""

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
