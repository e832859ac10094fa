"""Scalar column helpers."""

from .columns import (first_match, isin_ci, lenient_double, lenient_int, lenient_timestamp,
                      safe_ratio, ts_lit)

__all__ = ["first_match", "isin_ci", "lenient_double", "lenient_int", "lenient_timestamp",
           "safe_ratio", "ts_lit"]
