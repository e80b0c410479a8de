"""Scalar functions: object ids, the BSON codec, and their column forms."""
