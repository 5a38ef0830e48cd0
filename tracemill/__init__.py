"""Evaluation-log analytics and corpus operators on PySpark."""
