"""Imports every query module so that the registry is complete."""
from civicledger.plans import q_views, q_analytics, q_features, q_quality, q_sources, q_risk, q_similarity, q_search, q_explain, q_history  # noqa: F401
