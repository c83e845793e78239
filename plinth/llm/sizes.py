"""What may be broadcast: tables whose rows and bytes were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a broadcast table holds at most, with 16 for each row; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def counted(df: DataFrame) -> int:
    """Bytes of all columns as text, with 16 for each row."""
    width = F.lit(16)
    for name in df.columns:
        width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    return df.agg(F.sum(width.cast("long")).alias("bytes")).first().bytes or 0


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (best a table that is written already) marked for broadcast if it was counted at ``most`` bytes or less."""
    return F.broadcast(df) if counted(df) <= most else df
