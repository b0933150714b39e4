"""Scoring of newly landed logs."""
