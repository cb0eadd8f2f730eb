"""Queries: each operator over the tables of a folder, with SQL that gives the same rows."""

from . import conflicts, filters, graphs, index, ingest, lifecycle, more, ordered, pairs, recall, rest, retrieval, stats, streams, textual, vocabulary, whole, writes
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "conflicts", "filters", "graphs", "index", "ingest", "lifecycle", "more", "ordered", "pairs", "recall", "rest", "retrieval", "stats", "streams", "textual", "vocabulary", "whole", "writes"]
