"""Training-data operators: tokenising, scanning, mixing and deduplicating text corpora.

Nothing outside this subpackage imports it.
"""
