"""Operators for preparing text for model training."""
