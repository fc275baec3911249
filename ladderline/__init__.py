"""Ranking analytics and training-data operators on PySpark."""
