"""All registered queries and their SQL."""

from __future__ import annotations

from . import (  # noqa: F401  registered on import
    file_queries,
    invariant_queries,
    join_queries,
    matrix_queries,
    metric_queries,
    model_queries,
    moment_queries,
    rank_queries,
    solver_queries,
    transform_queries,
)
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "x2_stage_shift"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
