"""The registered queries over the operators, with their SQL."""

from . import delimited, markup, messages, queries as _queries, reading, records, rules, shaping, sheets, tables  # noqa: F401  the others register their queries with those of tables


def queries() -> dict:
    return dict(tables.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(tables.SQL)
