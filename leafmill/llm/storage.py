"""Cutting lineage with tables in the folder that all executors share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, written

__all__ = ["broadcast_if_small", "shared_folder", "written"]
#: Rows of keys up to which a side is broadcast, after counting it.
BROADCAST = 1_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small. df is a written table, so counting it reads only footers."""
    return F.broadcast(df) if df.count() <= BROADCAST else df
