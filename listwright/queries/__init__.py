"""Registered queries over the driver tables, each with an equivalent in SQL where there is one."""

from listwright.queries.base import ORACLE, QUERIES


def load() -> None:
    from listwright.queries import branches, functions, kinds, listings, relations, scans, sources  # noqa: F401


__all__ = ["ORACLE", "QUERIES", "load"]
