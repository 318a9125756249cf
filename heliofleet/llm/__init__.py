"""Operators of a training-data pipeline: scoring, scanning, deduplication, packing and output of document tables."""
