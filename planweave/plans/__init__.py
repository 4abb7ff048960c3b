"""Whole chains composed of operators."""
