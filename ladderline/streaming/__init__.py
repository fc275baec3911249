"""Streaming forms of the append and of rank shocks."""
