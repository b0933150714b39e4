"""Compositions of operators: evaluation, experiments, log scoring."""
