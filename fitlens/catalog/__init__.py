"""Named queries over the driver tables, each with the SQL that checks it."""

from fitlens.catalog import matching, parsing, tables, tagging

_MODULES = (parsing, tagging, matching, tables)


def all_queries() -> dict:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def all_checks() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
