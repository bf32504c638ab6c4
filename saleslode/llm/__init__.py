"""Operators for preparing language-model training text.

One module per operator; each has its general function and the registered query built
on it. ``queries`` gathers the registered queries and their SQL twins. Nothing outside
this subpackage imports it, except the guarded entry in ``__spark_entry__``.
"""
