"""Relational-graph analytics on PySpark."""
