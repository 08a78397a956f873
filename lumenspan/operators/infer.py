"""Batch inference: a model loaded once for each Python worker, fed Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


_models: dict[str, Callable] = {}


def _loaded(key: str, load: Callable[[], Callable]) -> Callable:
    """The model of a call of infer, which a worker keeps over its tasks until another call's takes its place."""
    if key not in _models:
        _models.clear()
        _models[key] = load()
    return _models[key]


def infer(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], in_cols: Sequence[str], out_schema: T.StructType | str, keep: Sequence[str] = (), batch_size: int = 64) -> DataFrame:
    """`keep` columns with the model's outputs. load() gives the model: a function of a frame of in_cols, with as many rows out."""
    key = uuid.uuid4().hex
    out = T.StructType.fromDDL(out_schema) if isinstance(out_schema, str) else out_schema
    schema = T.StructType([*(df.schema[c] for c in keep), *out.fields])

    def run(frames):
        model = _loaded(key, load)
        for f in frames:
            for i in range(0, len(f), batch_size):
                part = f.iloc[i : i + batch_size].reset_index(drop=True)
                got = model(part[list(in_cols)]).reset_index(drop=True)
                if len(got) != len(part):
                    raise ValueError(f"the model gave {len(got)} rows for {len(part)}")
                yield pd.concat([part[list(keep)], got[out.names]], axis=1)

    return df.select(*dict.fromkeys([*keep, *in_cols])).mapInPandas(run, schema)
