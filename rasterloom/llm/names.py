"""Columns of a caller that have names which an operator needs for itself, in whatever case."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that clash with names under names that nothing has, and the own name of each of them."""
    own = {n.lower() for n in names}
    used = own | {c.lower() for c in docs.columns}
    moved = {}
    for c in docs.columns:
        if c.lower() in own:
            k = 0
            while f"set_aside_{k}" in used:
                k += 1
            used.add(f"set_aside_{k}")
            moved[f"set_aside_{k}"] = c
    return docs.withColumnsRenamed({c: n for n, c in moved.items()}), moved
