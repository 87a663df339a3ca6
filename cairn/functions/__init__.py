"""Column functions of the engine, by name: each takes and gives Columns, and needs no shuffle."""

from cairn.operators.alloc import hash_order, uniform
from cairn.operators.evidence import edge_sign, ladder
from cairn.operators.filters import finite_non_negative, has_forbidden, trusted
from cairn.operators.joins import dot, squared_distance
from cairn.operators.matrix import (
    bounded_add,
    derived_seed,
    is_closed,
    lenient_bool,
    lenient_double,
    library_scaled,
    log_cp10k,
    logistic_score,
    non_negative,
    one_hot,
    rate_decoded,
    restore_cp10k,
    shrink_weight,
    spline_basis,
    standard_error,
    to_library,
    tokens,
    unit_rows,
    variance_shrunk,
)
from cairn.operators.metrics import normal_tail, overlap_score, skill
from cairn.operators.moments import lagrange
from cairn.operators.ranks import normal_quantile

__all__ = [name for name in dir() if not name.startswith("_")]
