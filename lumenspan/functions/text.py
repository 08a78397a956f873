"""Expressions on texts, ids, parameters and JSON."""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: An entity with its semicolon.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([0-9A-Za-z]+));")


def snake_case(name: Column) -> Column:
    """CamelCase to snake_case, runs of capitals kept together."""
    apart = F.regexp_replace(name, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(apart, r"([a-z0-9])([A-Z])", "$1_$2"))


def _closed(t: str) -> str:
    return _CLOSED.sub(lambda m: m[0] if m[1] and m[1] + ";" not in html.entities.html5 else html.unescape(m[0]), t)


def unescape_html(text: Column, levels: int = 1, closed: bool = False) -> Column:
    """Entities as their characters, so many levels of them, as the HTML standard reads them.

    From left to right, each once a level: numbers in both bases, and the longest name of the standard's table that
    begins there, with or without its semicolon; what is none stays. Texts without & don't change. closed: only
    entities that end in their semicolon, so that one which a cut text ends in stays.
    """
    undo = _closed if closed else html.unescape

    @F.pandas_udf("string")
    def undone(texts: pd.Series) -> pd.Series:
        def one(t):
            for _ in range(levels):
                if t is None or "&" not in t:
                    break
                t = undo(t)
            return t

        return texts.map(one)

    return undone(text)


def clean_text(text: Column, lower: bool = True, closed: bool = False) -> Column:
    """HTML entities undone twice (closed: as there), white space (the no-break space too) collapsed to one space and trimmed, lower case."""
    flat = F.trim(F.regexp_replace(unescape_html(text, 2, closed), r"[\s\u00a0]+", " "))
    return F.lower(flat) if lower else flat


def prompts(df: DataFrame, term: str, templates: Sequence[str], negative: bool = False) -> DataFrame:
    """One row for each of the caller's templates, {} standing for the term, with prompt_idx and prompt; negative prompts are of "Not " + term."""
    word = F.concat(F.lit("Not "), F.col(term)) if negative else F.col(term)
    return df.select("*", F.posexplode(F.array(*map(F.lit, templates))).alias("prompt_idx", "_t")).withColumn("prompt", F.replace(F.col("_t"), F.lit("{}"), word)).drop("_t")


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")


def valid_id(value: Column) -> Column:
    """32 lower-case hexadecimal digits."""
    return F.coalesce(value.rlike(r"\A[a-f0-9]{32}\z"), F.lit(False))


def cast_parameter(kind: Column, value: Column) -> Column:
    """A struct (s, i, f, b) with the field of the parameter's kind set; what can't be read is null; only "False" is false."""
    return F.struct(
        F.when(kind == "STRING", value).alias("s"),
        F.when(kind == "INT", value.try_cast("bigint")).alias("i"),
        F.when(kind == "FLOAT", value.try_cast("double")).alias("f"),
        F.when(kind == "BOOL", value != "False").alias("b"),
    )


def flatten_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Fields of nested structs as columns with dotted names; lists stay."""

    def walk(fields, path):
        for f in fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, at)
            else:
                col = F.col(f"`{at[0]}`")
                for name in at[1:]:
                    col = col.getField(name)
                yield col.alias(sep.join(at))

    return df.select(*walk(df.schema.fields, []))


def look_up(json: Column, path: str) -> Column:
    """The value at a dotted path; numbers are places of lists; null where it is missing."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.get_json_object(json, "$" + steps)


def result_key(operator: Column, version: Column, inputs: Mapping[str, Column], parameters: Mapping[str, Column], output: Column | None = None) -> Column:
    """SHA-256 of the JSON of operator, version, named inputs and parameters, names in order."""
    named = lambda d: F.struct(*(d[k].alias(k) for k in sorted(d))) if d else F.lit("{}")
    return F.sha2(F.to_json(F.struct(operator.alias("operator"), version.alias("version"), (output if output is not None else F.lit("")).alias("output"), named(inputs).alias("inputs"), named(parameters).alias("parameters"))), 256)


def fit_context(tokens: Column, length: int, pad: int = 0) -> Column:
    """Tokens padded or cut to `length`; a cut keeps the last one as the end mark."""
    n = F.size(tokens)
    cut = F.concat(F.slice(tokens, 1, length - 1), F.slice(tokens, -1, 1))
    return F.when(n > length, cut).otherwise(F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - n))))
