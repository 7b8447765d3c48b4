"""Comparable queries of every operator."""

from tallyveer.registry.core import ORACLES, QUERIES


def load():
    """All registered queries and their SQL."""
    from tallyveer.registry import (  # noqa: F401
        data_queries,
        stage_queries,
        stream_queries,
        view_queries,
    )

    return dict(QUERIES), dict(ORACLES)
