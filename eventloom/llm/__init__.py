"""Training-data operators: one module per operator, queries in :mod:`eventloom.llm.queries`.

Nothing else in the library imports this subpackage.
"""
