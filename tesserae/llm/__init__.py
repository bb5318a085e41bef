"""Training-data operators: chat formatting, host rules, tokenisation, near-duplicate and
substring removal, WARC salvage, classifiers, packing and fingerprints.

Nothing else in the package imports this subpackage, so it can be removed as a whole.
"""
