"""Operators of a training-data pipeline (language ID, deduplication, decontamination, quality, packing ...)."""
