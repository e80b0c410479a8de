"""Readers of BSON files."""
