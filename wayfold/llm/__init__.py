"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage.  ``queries.py`` registers
the operators, ``oracle.py`` holds the SQL that states the same results.
"""
