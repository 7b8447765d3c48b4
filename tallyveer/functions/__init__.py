"""Scalar column functions shared by the operators."""

from tallyveer.functions.scalar import (
    attach,
    clamp,
    finite_or_null,
    half_even,
    pct_change,
    quoted,
    signed_pct,
    tree_path_length,
)

__all__ = [
    "attach",
    "clamp",
    "finite_or_null",
    "half_even",
    "pct_change",
    "quoted",
    "signed_pct",
    "tree_path_length",
]
