"""Operators by name, with what they require, provide and take; pipelines of named steps; incremental runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import result_key
from ..schemas import TABLES, SchemaMismatch


@dataclass(frozen=True)
class Operator:
    name: str
    call: Callable[..., Any]
    requires: Mapping[str, str]
    provides: Mapping[str, str]
    parameters: Mapping[str, Any] = field(default_factory=dict)
    version: str = "1.0"
    optional: frozenset[str] = frozenset()


_KNOWN: dict[str, Operator] = {}


def operator(name: str, requires: Mapping[str, str], provides: Mapping[str, str], parameters: Mapping[str, Any] | None = None, version: str = "1.0", optional: Sequence[str] = ()):
    """Register a function of input tables and parameters. requires and provides: names -> typed tables ("" for any)."""

    def add(call):
        _KNOWN[name] = Operator(name, call, dict(requires), dict(provides), dict(parameters or {}), version, frozenset(optional))
        return call

    return add


def list_operators() -> list[Operator]:
    return [_KNOWN[n] for n in sorted(_KNOWN)]


def _check(op: Operator, inputs: Mapping[str, DataFrame]) -> None:
    missing = set(op.requires) - set(inputs) - op.optional
    if missing:
        raise SchemaMismatch(f"{op.name} needs {', '.join(sorted(missing))}")
    unknown = set(inputs) - set(op.requires)
    if unknown:
        raise SchemaMismatch(f"{op.name} takes no {', '.join(sorted(unknown))}")
    for name, df in inputs.items():
        kinds = [k for k in op.requires[name].split("|") if k]
        needed = [set(_columns(k)) for k in kinds]
        if kinds and not any(n <= set(df.columns) for n in needed):
            raise SchemaMismatch(f"{op.name}: {name} lacks columns of {op.requires[name]}")


#: The columns that operators rely on; others of the typed tables may be missing.
_CORE = {"series": ("media_id", "time", "y"), "shots": ("media_id", "shot_idx", "start_s", "end_s"), "boxes": ("media_id", "id", "x", "y", "w", "h"), "embeddings": ("media_id", "id", "embedding"), "frames": ("media_id", "frame_idx")}


def _columns(kind: str) -> Sequence[str]:
    return _CORE.get(kind, TABLES[kind].names if kind in TABLES else ())


def run(name: str, inputs: Mapping[str, DataFrame], parameters: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """The operator's outputs by name. Parameters are merged for this call alone; unknown ones raise."""
    if name not in _KNOWN:
        raise KeyError(f"no operator {name!r}")
    op = _KNOWN[name]
    _check(op, inputs)
    unknown = set(parameters or {}) - set(op.parameters)
    if unknown:
        raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    out = op.call(**inputs, **{**op.parameters, **(parameters or {})})
    return out if isinstance(out, dict) else {next(iter(op.provides)): out}


@dataclass(frozen=True)
class Step:
    operator: str
    inputs: Mapping[str, str]
    outputs: Mapping[str, str]
    parameters: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    """Steps that bind inputs and outputs to symbols; the chain stays one lazy plan."""

    steps: Sequence[Step]

    def run(self, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        known = dict(tables)
        for step in self.steps:
            missing = [s for s in step.inputs.values() if s not in known]
            if missing:
                raise KeyError(f"{step.operator}: no table {missing[0]!r}")
            out = run(step.operator, {i: known[s] for i, s in step.inputs.items()}, step.parameters)
            known |= {symbol: out[name] for name, symbol in step.outputs.items()}
        return known


def with_result_keys(requests: DataFrame, inputs: Sequence[str] = ("input_id",), parameters: Sequence[str] = (), outputs: str | None = None) -> DataFrame:
    """Requests (operator, version, inputs, parameters) with the key of their result."""
    return requests.withColumn("result_key", result_key(F.col("operator"), F.col("version"), {c: F.col(c) for c in inputs}, {c: F.col(c) for c in parameters}, F.col(outputs) if outputs else None))


def run_incremental(requests: DataFrame, ledger: DataFrame, group: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(todo, done) of requests (request_id, result_key): a request is done if the ledger has all its outputs' keys."""
    have = ledger.select("result_key").distinct().withColumn("_h", F.lit(True))
    met = requests.join(have, "result_key", "left")
    open_ = met.where("_h is null").select(group).distinct()
    return requests.join(open_, group, "left_semi"), requests.join(open_, group, "left_anti")
