"""Operators for preparing training text at scale, their queries, and what they share."""
