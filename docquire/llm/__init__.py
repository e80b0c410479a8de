"""Training-data operators: mixing, quality, deduplication, decontamination,
toxicity, personal data, web archives and token output.

Nothing outside this subpackage imports it.
"""
