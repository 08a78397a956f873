"""The typed tables: media data as long tables, keyed by media_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BinaryType(), "t": T.BooleanType(), "S": T.ArrayType(T.StringType()), "D": T.ArrayType(T.DoubleType()), "F": T.ArrayType(T.FloatType())}


def _table(fields: str) -> T.StructType:
    """name:type pairs; types by letter, see _TYPES."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (f.split(":") for f in fields.split())])


_EMBEDDING = "media_id:s id:s ref_id:s time:d delta_time:d embedding:F"
TABLES: dict[str, T.StructType] = {
    "packets": _table("id:s version:s type:s name:s ref_id:s"),
    "series": _table("media_id:s series_id:s label:s label_idx:i time:d y:d delta_time:d"),
    "hist": _table("media_id:s time:d bin:i value:d"),
    "colors": _table("media_id:s rank:i time:d r:d g:d b:d delta_time:d"),
    "shots": _table("media_id:s shot_idx:i start_s:d end_s:d"),
    "annotations": _table("media_id:s start_s:d end_s:d labels:S"),
    "boxes": _table("media_id:s id:s ref_id:s image_id:s frame_idx:i time:d delta_time:d x:d y:d w:d h:d det_score:d"),
    "keypoints": _table("media_id:s id:s ref_id:s image_id:s frame_idx:i time:d delta_time:d x:D y:D"),
    "faces": _table("media_id:s id:s ref_id:s"),
    "frames": _table("media_id:s id:s ref_id:s frame_idx:i time:d delta_time:d ext:s content:b"),
    "media": _table("media_id:s kind:s filename:s ext:s content:b sha1:s"),
    "embeddings": _table(_EMBEDDING),
    "text_embeddings": _table("id:s text:s label_idx:i embedding:F"),
    "temporal_embeddings": _table(f"{_EMBEDDING} kind:s"),
    "strings": _table("media_id:s id:s ref_id:s text:s"),
    "clusters": _table("media_id:s cluster_id:s member_id:s member_ref_id:s is_sample:t size:l"),
    "places": _table("media_id:s id:s ref_id:s time:d level:s class:s prob:d"),
    "place_clusters": _table("media_id:s cluster_id:s member_id:s member_ref_id:s is_sample:t size:l level:s class:s prob:d"),
}


class SchemaMismatch(ValueError):
    """A table lacks columns of its type, or has them with another type."""


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of the typed table in order; columns of another type, and missing ones, raise."""
    if name not in TABLES:
        raise SchemaMismatch(f"unknown table type {name!r}")
    have = dict(df.dtypes)
    wrong = [f"{f.name}: {have.get(f.name, 'missing')} is not {f.dataType.simpleString()}" for f in TABLES[name] if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise SchemaMismatch(f"{name}: " + "; ".join(wrong))
    return df.select(*TABLES[name].names)
