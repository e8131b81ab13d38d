"""Operators for preparing training text and token data on Spark."""
