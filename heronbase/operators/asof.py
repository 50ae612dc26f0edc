"""As-of join: for each row of the left side the last row of the right side before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, ties: Sequence[str] = (), strict: bool = False, how: str = "left") -> DataFrame:
    """``left``'s columns and the struct ``match``: the row of ``right`` with equal ``by`` and the largest time not after the left one's.

    ``strict``: only times before it.  Among equal times the largest by ``ties`` wins.  Rows
    of both sides stand in one list, sorted once by time; a running last value finds the
    match, so work does not grow with the number of pairs and no key is held in memory.
    Null keys and null times match nothing; ``how="inner"`` leaves out rows without match.
    """
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    # among equal times, right rows count if they stand before the left ones
    side = lambda is_left: F.lit(0 if is_left == strict else 1).alias("__side")
    order = [F.col(t) for t in ties]
    null = lambda df: F.lit(None).cast(df.select(F.struct("*").alias("x")).schema["x"].dataType)
    a = left.select(*keys, F.col(left_time).alias("__t"), side(True), F.struct(*[F.lit(None).cast(right.schema[t].dataType).alias(t) for t in ties], F.lit(0).alias("__")).alias("__tie"), F.struct("*").alias("__left"), null(right).alias("__right"))
    b = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("__t"), side(False), F.struct(*order, F.lit(0).alias("__")).alias("__tie"), null(left).alias("__left"), F.struct("*").alias("__right"))
    names = [f"__k{i}" for i in range(len(by))]
    line = Window.partitionBy(*names).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for k in ("__t", *names):
        known = known & F.col(k).isNotNull()
    found = a.unionByName(b).withColumn("__found", F.last("__right", ignorenulls=True).over(line)).where(F.col("__left").isNotNull())
    out = found.select("__left.*", F.when(known, F.col("__found")).alias("match"))
    return out.where(F.col("match").isNotNull()) if how == "inner" else out
