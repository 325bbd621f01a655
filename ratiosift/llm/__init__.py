"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage; it may be deleted and the rest still works.
"""
