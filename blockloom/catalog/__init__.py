"""The registered queries with their SQL counterparts, one module per group of operators.

Every module has ``QUERIES`` (name -> function of session and table folder) and ``ORACLES`` (name -> SQL).
"""

from blockloom.catalog import extraction, files, language, packed, streams, tokens

MODULES = (extraction, tokens, packed, files, streams, language)


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
