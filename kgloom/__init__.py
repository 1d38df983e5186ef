"""kgloom: a PySpark-native engine for knowledge-graph ingest, checking and reconciliation."""

__version__ = "0.1.0"
