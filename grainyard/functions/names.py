"""Names of columns that an operator adds for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as it takes for df to have no such column."""
    taken, lead = {c.lower() for c in df.columns}, "_"
    while any(lead + n.lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]
