"""Query plans: base-table build, cohort, signals, feedback rules, seeding run."""

from .base_table import build_base_table, captain_mapping, order_scope
from .cohort import eligible_cohort, normalize, scoped_orders
from .seeding import run_seeding

__all__ = ["build_base_table", "captain_mapping", "order_scope", "eligible_cohort", "normalize",
           "scoped_orders", "run_seeding"]
