"""Operators over rank history and over request events."""
