"""Operators of a training-data pipeline: packing, personal data, deduplication, quality, language, mixing,
token counts and vector search.  Nothing else in the library imports this subpackage."""
