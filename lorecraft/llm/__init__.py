"""Operators that prepare text corpora for language-model training.

Each module holds one operator with its own general interface; ``queries`` binds them to
the tables of a folder. Nothing outside this subpackage imports it.
"""
