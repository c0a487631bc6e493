"""Imports every query module, which fills the registry."""

from platewise.plans import queries_cases, queries_cleaning, queries_models, queries_pairs, queries_profiles, queries_reports, queries_sources, queries_splits, queries_stats  # noqa: F401
from platewise.plans.catalog import ORACLES, QUERIES  # noqa: F401
