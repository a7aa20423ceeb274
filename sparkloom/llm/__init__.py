"""Training-data operators: quality, tokens, media, near-duplicates, urls, mixing and packing.

Nothing outside this subpackage imports it.  Every module keeps one operator with a general
interface; ``queries`` holds the thin registered queries built on them.
"""
