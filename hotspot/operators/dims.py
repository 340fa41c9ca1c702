"""Joins against small dimension tables.

Size policy: a dimension whose size is a fixed constant (the 4 sensors) is broadcast
explicitly. Every other dimension (projects, per-group bounds, project boxes) is joined
plainly and the broadcast decision is left to Spark's size check: Catalyst broadcasts a
side whose estimated size is under spark.sql.autoBroadcastJoinThreshold, and AQE
re-plans with the real size once a stage has run; above it the join stays a shuffle
(sort-merge) join. No extra job is spent counting a dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_broadcast(dim: DataFrame) -> DataFrame:
    """Broadcast a dimension whose size is a fixed constant (e.g. the 4 sensors)."""
    return F.broadcast(dim)


def dim_join(fact: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """Fact x dimension join; broadcast chosen by Spark's size check (see module doc)."""
    return fact.join(dim, on, how)
