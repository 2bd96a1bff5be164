"""Registered queries and the SQL that checks them."""

from tidemark.plans import boost, encode, evidence, fitted, graph, history, members, metrics, more, predicates, sources, splits
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "boost", "encode", "evidence", "fitted", "graph", "history", "members", "metrics", "more", "predicates", "sources", "splits"]
