"""Relational, feature, model and metric operators."""
