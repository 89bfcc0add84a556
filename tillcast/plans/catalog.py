"""Imports every query family so that the registry is complete."""

from tillcast.plans import registry
from tillcast.plans import q_anomaly, q_basket, q_explore, q_features, q_forecast, q_prepare, q_profile, q_segment  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
