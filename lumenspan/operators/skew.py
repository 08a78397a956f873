"""Joins with keys that a large share of the rows may have, and partitions of so many rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a partition that a task sorts.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, keys: Sequence[str], rows: int, each: int | None = None) -> DataFrame:
    """df by the hash of its keys in partitions of about `each` (TASK_ROWS) of so many rows, at least as many as the session has.

    The number is stated, so adaptive execution doesn't put partitions together by their compressed bytes, of which
    a row of few numbers has one or two, and a task's memory doesn't grow with the table.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (each or TASK_ROWS)))
    return df.repartition(n, *keys)


def join_counted(left: DataFrame, right: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """left joined with right, whatever share of left one key has.

    right has one row a key, with `n`, the number of left's rows that have it, and total is the number of all. Keys
    of more than a thousandth of them are a thousand at most: these are broadcast, and the others shuffled.
    """
    keys, is_large = list(keys), F.col("n") > max(1, total // 1_000)
    large = left.join(F.broadcast(right.where(is_large)), keys)
    return large.unionByName(left.join(F.broadcast(right.where(is_large).select(*keys)), keys, "left_anti").join(right.where(~is_large), keys))
