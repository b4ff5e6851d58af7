"""Marketplace operators: each is ``f(tables, ...) -> DataFrame``."""
