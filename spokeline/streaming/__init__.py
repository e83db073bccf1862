"""Stateful streaming pipelines."""
