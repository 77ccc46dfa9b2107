"""Every business and physical parameter, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Parameters of a warehouse build.

    The first block are metric definitions. The second are physical limits: they
    change how the work is split over tasks, never what it returns.
    """

    reporting_tz: str = "Asia/Dubai"
    retention_window_days: int = 30
    tenure_new_max_prior_orders: int = 2
    late_threshold_minutes: int = 60
    mad_k: float = 20.0
    srm_threshold: float = 0.001
    min_cell: int = 100
    unmapped_label: str = "Unmapped"
    # Without them the calendar spans the order dates of the data; the end is left out.
    calendar_start: str | None = None
    calendar_end: str | None = None
    high_intent_categories: tuple[str, ...] = (
        "Dairy & Eggs",
        "Fresh Produce",
        "Baby",
        "Meat & Poultry",
    )

    # A key with more rows than hot_rows is split into cells of about cell_rows;
    # None keeps every key whole.
    hot_rows: int | None = 4_000_000
    cell_rows: int = 1_000_000
    # A stored dimension with more versions of one key than this is joined by carrying the
    # last version forward, not by comparing each fact with each version.
    many_versions: int = 64


# The end of an open validity range, and the swap types from the
# most to the least disruptive replacement.
OPEN_END = "2999-12-31"
SWAP_SEVERITY = (
    "diff_product_same_cat",
    "diff_brand_same_product",
    "same_brand_diff_size",
)
BASKET_EDGES = (3, 6, 10, 15)
BASKET_LABELS = ("1-3", "4-6", "7-10", "11-15", "16+")
