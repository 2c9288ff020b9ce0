"""Training-data operators: mixing, media, near-duplicates, packing, search,
chat, personal data, token files, toxicity and secrets.

Self-contained: nothing outside this package imports it.
"""
