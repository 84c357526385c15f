"""Operators of a training-data pipeline: documents in, decisions, tokens and files out."""
