"""Query and update operators over typed DataFrames."""
