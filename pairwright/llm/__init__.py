"""Training-data operators: sharding, scans, classifiers, formatting, fingerprints, tokenising, joins and decontamination.

Nothing else in the library imports this subpackage. Each module holds one operator with a general
interface; ``registry`` derives the thin contract queries from them.
"""
