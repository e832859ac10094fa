"""Run configuration: every literal the job depends on lives here, once.

``RunConfig`` is frozen so a plan built from it cannot drift from the values
reported in the metrics table.  Two factories are provided:

* ``production_config`` -- the label vocabularies, city lists and thresholds of
  the original job (fixed values, stated below in their natural order).
* ``fixture_config`` -- the same rules pointed at the TPC-H-shaped test tables
  (regions play the role of cities, ``as_of`` is 2000-01-01).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


def _months_before(d: dt.date, months: int) -> dt.date:
    """Calendar month arithmetic with month-end clamping (2024-08-31 - 6m = 2024-02-29)."""
    y, m = divmod(d.year * 12 + (d.month - 1) - months, 12)
    m += 1
    for day in (d.day, 30, 29, 28):
        try:
            return dt.date(y, m, day)
        except ValueError:
            continue
    raise ValueError(d)


# --------------------------------------------------------------------------
# Fixed values of the original job (must stay equal for equal results).
# --------------------------------------------------------------------------
# City ids of the order log and rider snapshot: Hyderabad, Jaipur, Chennai,
# Bangalore, Kolkata, Delhi, Mumbai.
PROD_CITY_IDS = (
    "5740135d4fdf4798208bba24",
    "5ba090686fde19440c388a07",
    "57af2db19729ad145ddbba66",
    "572ca7ff116b5db3057bd814",
    "5bc5acb112477c2ece769599",
    "5bc5ac2312477c2ece769591",
    "5bc5ac7012477c2ece769595",
)
# Lower-case city names used by the event tables.
PROD_CITY_NAMES = ("bangalore", "hyderabad", "jaipur", "chennai", "kolkata", "delhi", "mumbai")
PROD_MODE_ID = "5fbe8a6fb1c45500077393da"
PROD_QUESTION_IDS = (
    "69c5042209637f1e5928ea8c",
    "69a0409cbf982b02b7c76713",
    "69b7fbd7eff2e7db86ff29a7",
    "69e8b9154c3ca1633f34f5e6",
    "69b7feab0f2fd330c732f88f",
    "69eb2fe47dd5f8572670ac3d",
)
PROD_SHIFT_LIST = (
    "BLR_LINK", "BLR_CU", "BLR_KM", "BLR_CU1", "FT_Bounce_BLR",
    "BLR_MC_Bellandur", "BLR_BIKE_LINK_PINK", "BLR_Zero Commission",
    "BLR_KM1", "BLR_commision10", "BLR_Low_APR", "BLR_MC_Bellandur_1",
    "BLR_MC_Bellendur", "BLR_MG", "BLR_Test", "BLR_Test_KM", "BLR_rated_women",
)
# Service-name keyword classes, checked in this order (first match wins).
SERVICE_CLASSES = (
    ("prefbyher", ("bike rated by women",)),
    ("bike_scooter", ("scooty",)),
    ("bike_motorbike", ("bike", "link")),
)
SERVICE_CLASS_DEFAULT = "others"
SERVICE_LEVELS = ("Link", "Scooty", "Bike Rated by Women")
TEXT_INPUT_TYPES = ("CHAT", "SUPPORT_TICKET", "POST_RIDE_REVIEW")
CANCEL_EVENT_TYPES = ("rider_cancelled", "customer_cancelled")
CHAT_ISSUES = ("demanded extra cash", "No issue", "pickup location issue", "rude behavior")
CHAT_RUDE = "rude behavior"
TICKET_TIERS_ALL = ("P0", "P1", "P2", "P3")
TICKET_TIERS_REMOVE = ("P0", "P1")
REVIEW_LABELS = ("L0_HIGHEST_THREAT", "L1_HIGH_CONCERN", "L2_MEDIUM", "L3_POSITIVE")
YES_LABELS = ("Yes", "Yes, I felt safe!", "Yes, I felt safe")
NO_LABEL = "No"
LIVE_FEEDBACK_TAG = "liveFeedback"
RATING_SCREEN_TAG = "ratings"


@dataclass(frozen=True)
class RunConfig:
    as_of: dt.date
    window_months: int = 6
    active_months: int = 3
    # scope
    city_ids: tuple[str, ...] = PROD_CITY_IDS
    city_names: tuple[str, ...] = PROD_CITY_NAMES
    service_categories: tuple[str, ...] = ("link",)
    cancel_services: tuple[str, ...] = ("link",)
    mode_id: str = PROD_MODE_ID
    service_levels: tuple[str, ...] = SERVICE_LEVELS
    question_ids: tuple[str, ...] = PROD_QUESTION_IDS
    start_day: str | None = None  # yyyymmdd, inclusive; default as_of - window
    end_day: str | None = None  # yyyymmdd, inclusive; default as_of
    # cohort
    female_code: int = 1
    male_code: int = 0
    female_min_rides: int = 3
    female_min_rated: int = 1
    rated_values: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0, 5.0)
    bad_values: tuple[float, ...] = (1.0, 2.0, 3.0)
    dropped_status: str = "dropped"
    # signals
    chat_issues: tuple[str, ...] = CHAT_ISSUES
    chat_rude: str = CHAT_RUDE
    ticket_tiers_all: tuple[str, ...] = TICKET_TIERS_ALL
    ticket_tiers_remove: tuple[str, ...] = TICKET_TIERS_REMOVE
    review_labels: tuple[str, ...] = REVIEW_LABELS
    min_rides_per_gender: int = 5
    q_review: float = 0.95
    review_default: float = 1.0
    q_calls_cap: float = 0.99
    q_calls: float = 0.98
    floor_rate: float = 0.05
    floor_vol: float = 0.30
    floor_cv: float = 0.10
    cv_min_female_rate: float = 0.10
    cv_eps: float = 1e-6
    votes_needed: int = 2
    q_cancel_hi: float = 0.98
    q_cancel_lo: float = 0.02
    cancel_hi_default: float = 1.0
    cancel_lo_default: float = -1.0
    # explicit feedback
    yes_labels: tuple[str, ...] = YES_LABELS
    no_label: str = NO_LABEL
    live_min_total: int = 1  # strictly greater than
    rating_min_total: int = 2  # strictly greater than
    rating_min_pct_yes: float = 90.0  # one value for rule and audit (see README)
    # final list
    shift_list: tuple[str, ...] = PROD_SHIFT_LIST
    apply_shift_filter: bool = False
    top_k_audit: int = 5
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    # ---- derived dates -------------------------------------------------
    @property
    def window_start(self) -> dt.date:
        return _months_before(self.as_of, self.window_months)

    @property
    def active_start(self) -> dt.date:
        return _months_before(self.as_of, self.active_months)

    @property
    def day_from(self) -> str:
        return self.start_day or self.window_start.strftime("%Y%m%d")

    @property
    def day_to(self) -> str:
        return self.end_day or self.as_of.strftime("%Y%m%d")

    @property
    def run_tag(self) -> str:
        """``ddmonyyyy`` lower case, e.g. ``01jan2000``."""
        months = "jan feb mar apr may jun jul aug sep oct nov dec".split()  # not strftime's %b, which follows the locale
        return f"{self.as_of.day:02d}{months[self.as_of.month - 1]}{self.as_of.year}"

    def with_(self, **kw) -> "RunConfig":
        return replace(self, **kw)


def production_config(as_of: dt.date | None = None) -> RunConfig:
    return RunConfig(as_of=as_of or dt.date.today())


# Fixture scope: regions stand in for cities; MIDDLE EAST is out of scope.
FIXTURE_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")


def fixture_config(**kw) -> RunConfig:
    base = dict(
        as_of=dt.date(2000, 1, 1),
        city_ids=FIXTURE_REGIONS,
        city_names=tuple(r.lower() for r in FIXTURE_REGIONS),
        mode_id="mode_link",
        question_ids=tuple(f"q{i}" for i in range(7)),
        shift_list=tuple(f"SHIFT_{i}" for i in range(4)),
    )
    base.update(kw)
    return RunConfig(**base)
