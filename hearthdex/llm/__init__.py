"""Operators that prepare text and code for language-model training.

Nothing else in hearthdex imports this subpackage.
"""
