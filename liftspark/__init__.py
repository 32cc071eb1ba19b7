"""Row-wise Python functions turned into Spark plans.

    from liftspark import func, where, with_columns

    @func(return_dtype="float64")
    def taxed(price):
        return price * 1.07 + 0.5

    with_columns(orders, {"taxed": taxed(F.col("o_totalprice"))})

A function is read at plan time; what has an exact Spark equivalent becomes a
Catalyst expression (tier 1), what is pure but has none runs over Arrow
batches (tier 2), and the rest as a row function (tier 3).
"""

from .config import EngineConfig, Policy
from .ops import select, where, with_column, with_columns
from .udf import func

__all__ = ["EngineConfig", "Policy", "func", "select", "where", "with_column", "with_columns"]
