"""Operators for preparing training data: quality votes, secret scans, token files,
packing, exact and near-duplicate removal, top-k search, mixing and URL filters.

Nothing else in the library imports this package.  Each operator module has its own
general interface; ``orrery.llm.queries`` holds the registered queries.
"""
