"""Reads of curated tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def scan_curated(
    tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]
) -> dict[str, DataFrame]:
    """Column-pruned tables; raises when one of them has no rows."""
    picked = {name: tables[name].select(*cols) for name, cols in columns.items()}
    empty = [name for name, df in picked.items() if df.isEmpty()]
    if empty:
        raise RuntimeError(f"no rows in curated {', '.join(empty)}")
    return picked
