"""Filters: parsing, normal form, compilation to columns, and matching of single documents."""
