"""Registered queries, each with the plain SQL that must give the same rows."""

from overstats.catalog.base import ORACLE, QUERIES  # noqa: F401


def load() -> None:
    """Import every module that registers queries."""
    from overstats.catalog import (  # noqa: F401
        cohorts, identity, matches, models, players, publishing, reading, scalars, states,
    )
