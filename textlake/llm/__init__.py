"""Training-data operators: mixing, URL rules, token counts, quality, language, near duplicates,
licenses, sharding, decontamination and passage de-duplication.

Self-contained: nothing else in the library imports this subpackage.
"""
