"""Training-data operators: packing, near-duplicates, URL filters, decontamination,
sharding, quality, token files, page text, rules and language.

Nothing else in the library imports this subpackage.
"""
