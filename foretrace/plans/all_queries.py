"""Importing this module registers every query."""

from foretrace.plans import parts  # noqa: F401
from foretrace.plans import cohort_queries, feature_queries, forecast_queries, metric_queries, stat_queries, text_queries  # noqa: F401
