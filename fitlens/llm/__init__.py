"""Operators for building training corpora: one module each, named queries in ``queries``."""
