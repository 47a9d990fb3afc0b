"""Specifications expanded into plans."""

from riskloom.plans import measure_queries, feature_queries, basic_queries, model_queries, api_queries, selection_queries  # noqa: F401, I001  they register themselves
