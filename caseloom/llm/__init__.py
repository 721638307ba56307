"""Training-data operators: token files, classifiers, deduplication, mixing.

Nothing outside this subpackage imports it.
"""
