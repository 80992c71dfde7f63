"""Training-data operators: deduplication, packing, scoring, cleaning, search.

Nothing outside this subpackage imports it. Each module holds one operator with
its general interface; ``queries.py`` registers the thin ``opN_*`` queries.
"""
