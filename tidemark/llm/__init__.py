"""Operators of a training-data pipeline: mixing, packing, language ID, deduplication, media, tokens, pages, licences."""
