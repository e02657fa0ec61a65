"""Operators: each takes DataFrames and returns one lazy DataFrame."""

from tidepath.operators.activity import weekday_hour
from tidepath.operators.flows import (
    amount_quantiles,
    net_flow,
    path_counts,
    path_matrix,
    region_subtotals,
    size_bands,
)
from tidepath.operators.overview import (
    by_period,
    by_place,
    paths,
    top_paths_per_period,
    totals,
)
from tidepath.operators.parties import (
    approx_parties,
    cohort_retention,
    latest_per_key,
    new_and_returning,
    party_breadth,
    status_by_month,
    top_parties,
)
from tidepath.operators.series import (
    cumulative,
    daily_zero_filled,
    period_change,
    rank_places,
    rolling_7d,
)
from tidepath.operators.scalars import json_scalars
from tidepath.operators.sets import (
    bag_changes,
    bag_difference,
    bag_intersection,
    grouped_at_once,
    version_changes,
    with_partner,
)
from tidepath.operators.sketches import daily_sketches, sketched_parties, sketched_quantiles
from tidepath.operators.timejoins import asof_join, points_in_intervals, sessions
from tidepath.operators.transfers import daily_cube, transfers, transfers_filtered

__all__ = [
    "amount_quantiles",
    "approx_parties",
    "asof_join",
    "bag_changes",
    "bag_difference",
    "bag_intersection",
    "by_period",
    "by_place",
    "cohort_retention",
    "cumulative",
    "daily_cube",
    "daily_sketches",
    "daily_zero_filled",
    "grouped_at_once",
    "json_scalars",
    "latest_per_key",
    "net_flow",
    "new_and_returning",
    "party_breadth",
    "path_counts",
    "path_matrix",
    "paths",
    "period_change",
    "points_in_intervals",
    "rank_places",
    "region_subtotals",
    "rolling_7d",
    "sessions",
    "size_bands",
    "sketched_parties",
    "sketched_quantiles",
    "status_by_month",
    "top_parties",
    "top_paths_per_period",
    "totals",
    "transfers",
    "transfers_filtered",
    "version_changes",
    "weekday_hour",
    "with_partner",
]
