"""Tessera: deterministic record processing and analytics on PySpark."""
