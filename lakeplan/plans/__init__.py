"""The query catalogue: operators, scalars, statements and the TPC-H shapes."""

from . import operators, scalars, statements, tpch  # noqa: F401
from .registry import ORACLES, QUERIES, Tables  # noqa: F401
