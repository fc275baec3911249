"""Queries that put the operators together."""
