"""Relational, graph and time-series operators."""
