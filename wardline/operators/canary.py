"""Traffic split between two scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def arm(row_id: Column, percent: int) -> Column:
    """``canary`` for about ``percent`` of the ids, ``stable`` for the others; the same id, the same arm."""
    slot = F.conv(F.substring(F.md5(row_id.cast("string")), 1, 8), 16, 10).cast("long") % 100
    return F.when(slot < percent, F.lit("canary")).otherwise(F.lit("stable"))
