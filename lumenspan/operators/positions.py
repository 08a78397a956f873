"""Places and running values along the order of a group, in two levels, so that one large group is dealt over many tasks.

Rows are range-partitioned by group and order and sorted; a place in a partition and the number of rows of the group
in earlier partitions make the place in the group. Running values work alike: in each partition, and from a table of
one row for each group and partition what came before. The sorted rows are a checkpoint, as both levels have to see
the same partitions. Rows of equal order are parted by the number they come with, so they don't gather either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import shared_dir

_SHIFT = 33  # of monotonically_increasing_id: the partition's number is above


def _sorted(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    shared_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = [*(F.col(c) if isinstance(c, str) else c for c in (*by, *order)), F.col("_u")]
    ranged = df.withColumn("_u", F.monotonically_increasing_id()).repartitionByRange(n, *along).sortWithinPartitions(*along)
    return ranged.drop("_u").withColumn("_m", F.monotonically_increasing_id()).checkpoint()


def _joined(held: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with the row of its group and partition."""
    names = [*by, "_p"]
    parts = parts.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(names)})
    return held.join(parts, [F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)]).drop(*(f"_k{i}" for i in range(len(names))))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "_i") -> DataFrame:
    """Rows with their place from 0 in the order of their group."""
    held = _sorted(df, by, order).withColumn("_p", F.shiftright("_m", _SHIFT))
    parts = held.groupBy(*by, "_p").agg(F.min("_m").alias("_f"), F.count("*").alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_s", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    return _joined(held, parts, by).withColumn(name, F.col("_m") - F.col("_f") + F.col("_s")).drop("_m", "_p", "_f", "_c", "_s")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """Rows with the sums and the maxima of expressions over the rows of their group up to themselves."""
    sums, tops = sums or {}, tops or {}
    held = _sorted(df, by, order).withColumns({"_p": F.shiftright("_m", _SHIFT), **{f"_v{n}": e for n, e in (sums | tops).items()}})
    total = lambda n, c: F.sum(c) if n in sums else F.max(c)
    parts = held.groupBy(*by, "_p").agg(*(total(n, f"_v{n}").alias(f"_c{n}") for n in sums | tops))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_p", *(total(n, f"_c{n}").over(earlier).alias(f"_s{n}") for n in sums | tops))
    here = Window.partitionBy(*by, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = held.withColumns({f"_l{n}": total(n, f"_v{n}").over(here) for n in sums | tops})
    both = lambda n: F.coalesce(F.col(f"_s{n}"), F.lit(0)) + F.coalesce(F.col(f"_l{n}"), F.lit(0)) if n in sums else F.greatest(f"_s{n}", f"_l{n}")
    met = _joined(local, parts, by).withColumns({n: both(n) for n in sums | tops})
    return met.drop("_m", "_p", *(f"_{k}{n}" for n in sums | tops for k in "vls"))
