"""How these operators cut lineage and reach what the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import Folder, checkpoint_dir

__all__ = ["Folder", "checkpoint_dir", "only", "saved"]


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so a lost executor costs a reread only."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """These columns of a table that may hold others; a name that is missing is an error at once."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f"`{c}`"] for c in columns])
