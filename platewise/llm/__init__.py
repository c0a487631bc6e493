"""Operators that prepare text corpora for language-model training; nothing else in the library imports this package."""
