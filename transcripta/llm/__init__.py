"""Operators for preparing language-model training text.

Ten operators (``opN_*``), each a function ``DataFrame -> DataFrame`` with its
own general interface, plus the registered queries built on them
(``registry.py``).  Nothing else in the library imports this subpackage.
"""
