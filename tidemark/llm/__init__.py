"""Training-data operators: quality, tokens, language, secrets, media, urls, benchmarks, copies, packing.

Nothing else in the library imports this subpackage.
"""
