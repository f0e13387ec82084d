"""Whole plans: the registered queries and their SQL."""
