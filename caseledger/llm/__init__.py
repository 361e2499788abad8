"""Training-data operators: quality, language, toxicity, near duplicates,
tokenizing, mixing, URL and personal-data filters, nearest neighbours.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered ``opN_*`` queries.
"""
