"""Generic DataFrame -> DataFrame operators; column names are arguments."""

from .evidence import audit_part, audit_union, fixed4, joined_flags, kv
from .flags import exclude, flag_matrix, k_of_n, keep, overlap_counts, union_ids, vote_count
from .latest import latest_per_key, latest_per_key_by_case, latest_struct
from .quantile import (breach, cap_at, floor_at, lower_tail, quantile_col, quantile_nearest, quantile_row,
                       quantiles_from_counts, upper_tail, value_counts)
from .segments import max_then_sum, pivot_segments
from .topk import top_k_per_group

__all__ = [
    "audit_part", "audit_union", "fixed4", "joined_flags", "kv",
    "exclude", "flag_matrix", "k_of_n", "keep", "overlap_counts", "union_ids", "vote_count",
    "latest_per_key", "latest_per_key_by_case", "latest_struct",
    "breach", "cap_at", "floor_at", "lower_tail", "quantile_col", "quantile_nearest",
    "quantile_row", "quantiles_from_counts", "upper_tail", "value_counts",
    "max_then_sum", "pivot_segments",
    "top_k_per_group",
]
