"""Training-data operators: one module an operator, queries in ``queries``.

Nothing outside this package imports it; deleting the folder leaves the rest
of the library working.
"""
