"""Training-data operators: tokenisation, token files, filters, dedup, scoring.

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface; :mod:`lectern.llm.queries` applies them to
the driver's tables.
"""
