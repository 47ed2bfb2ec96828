"""Hybrid retrieval and corpus analytics as DataFrame operators on PySpark."""
