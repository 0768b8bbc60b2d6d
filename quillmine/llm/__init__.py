"""Operators for training-data pipelines: tokens, near-duplicates, media, chat, HTML, quality, packing, secrets.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
