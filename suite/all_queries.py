"""Importing this module registers every query."""

from suite import core, exchange_queries, history_queries, main_path_queries, pair_queries, report_queries, service_queries  # noqa: F401
