"""Readers, writers and table derivations."""
