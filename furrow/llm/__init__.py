"""Operators of a training-data pipeline: scoring, extraction, deduplication, mixing, tokenising.

Every operator takes and returns DataFrames; nothing outside this subpackage imports it.
"""
