"""Expressions on vectors (arrays of numbers), all within Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for each row, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def l2_normalise(a: Column) -> Column:
    """A zero vector stays zero."""
    unit = lambda v, n: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))
    return _let(a, lambda v: _let(norm(v), lambda n: unit(v, n)))


def mean_vector(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, vector): means by component; each component is summed on its own, so groups may be of any size."""
    parts = df.select(by, F.posexplode(vector).alias("_i", "_x")).groupBy(by, "_i").agg(F.avg("_x").alias("_x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))


def softmax(df: DataFrame, by: list[str], x: str, temperature: float = 1.0, out: str = "p") -> DataFrame:
    """softmax(x / temperature) within each group, shifted by the maximum."""
    w = Window.partitionBy(*by)
    e = df.withColumn("_e", F.exp((F.col(x) - F.max(x).over(w)) / temperature))
    return e.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def softmax_array(a: Column, temperature: float = 1.0) -> Column:
    powers = lambda v, top: F.transform(v, lambda x: F.exp((x.cast("double") - top) / temperature))
    shares = lambda e: _let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))
    return _let(a, lambda v: _let(F.array_max(v).cast("double"), lambda top: _let(powers(v, top), shares)))


def wide_to_long(df: DataFrame, vector: str, labels: list[str], value: str = "y") -> DataFrame:
    """One row for each component, with its label and label_idx; components beyond the labels are left out."""
    names = F.array(*map(F.lit, labels))
    long = df.select("*", F.posexplode(vector).alias("label_idx", value)).drop(vector)
    return long.where(F.col("label_idx") < len(labels)).withColumn("label", F.element_at(names, F.col("label_idx") + 1))


def flatten_batch(vectors: Column) -> Column:
    """The vectors of a batch (an array of arrays) as one vector, in order; those of deeper nesting level by level."""
    return F.flatten(vectors)


def stack_rows(df: DataFrame, by: list[str], how: str = "mean", vector: str = "embedding") -> DataFrame:
    """Mean or product over the vectors of a group, by component (vectors of one length)."""
    agg = F.product("_x") if how == "prod" else F.avg("_x")
    parts = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(agg.alias("_x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))


def amplitude_to_db(y: Column, top: Column, floor: float = 80.0, least: float = 1e-5) -> Column:
    """Decibels below `top`, not under -floor."""
    db = lambda x: 20 * F.log10(F.greatest(F.lit(least), x))
    return F.greatest(db(y) - db(top), F.lit(-floor))
