"""Training-data operators over ``documents``-like tables.

Nothing outside this subpackage imports it.  ``entry.py`` holds the thin
registered queries; every other module is one operator with its own interface.
"""
