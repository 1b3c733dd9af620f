"""Operators that prepare text corpora for training: one module each, with their queries in ``queries``."""
