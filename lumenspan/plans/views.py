"""Media tables derived from the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

#: name -> SQL; {x} is another view or a table. A pair is (Spark, DuckDB).
VIEWS: dict[str, str | tuple[str, str]] = {
    "series": (
        "select user_id as media_id, event_type as label, cast(case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as int) as label_idx, timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6 as time, value / (value + 10) as y from {events}",
        "select user_id as media_id, event_type as label, cast(case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as int) as label_idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 as time, value / (value + 10) as y from {events}",
    ),
    "shots": "select * from (select media_id, time as start_s, lead(time) over (partition by media_id order by time) as end_s, cast(row_number() over (partition by media_id order by time) - 1 as int) as shot_idx from {series} where label = 'error') z where end_s is not null",
    "lines": "select l_orderkey, l_linenumber, min(l_partkey) as pk, min(l_suppkey) as sk, min(l_quantity) as q, min(l_discount) as disc from {lineitem} group by l_orderkey, l_linenumber",
    "vectors": "select label as media_id, vec_id as id, vec_id * 3 as ref_id, cast(floor(vec_id / 4.0) as bigint) as frame_idx, cast(floor(vec_id / 4.0) as double) as time, embedding from {embeddings}",
    "boxes": "select sk as media_id, l_orderkey % 200 as frame_idx, l_orderkey * 10 + l_linenumber as id, l_orderkey as ref_id, cast(pk % 300 as double) as x, cast((pk * 7) % 200 as double) as y, cast(20 + q as double) as w, cast(20 + q * 2 as double) as h, 0.3 + cast(disc as double) * 6 as det_score from {lines}",
    "pixels": "select l_orderkey % 50 as media_id, l_orderkey as frame_idx, pk % 256 as r, (sk * 7) % 256 as g, cast(cast(q * 5 as int) % 256 as bigint) as b from {lines}",
    "faces": "select l_orderkey * 10 + l_linenumber as id, l_orderkey as ref_id from {lines}",
    "images": "select o_orderkey as id, o_custkey as media_id from {orders} where o_orderstatus = 'F'",
    "samples": "select media_id, row_number() over (partition by media_id order by time) - 1 as i, y from {series}",
    "segments": "select conv_id as media_id, turn, case when turn = 0 then null else cast(turn * 10 as double) end as start_s, case when turn = max(turn) over (partition by conv_id) then null else cast(turn * 10 + 10 as double) end as end_s, text from {conversations}",
    "frames": "select media_id, row_number() over (partition by media_id order by time) - 1 as frame_idx, time from {series}",
    "requests": "select o_orderpriority as operator, o_custkey as input_id, o_orderstatus as st from {orders}",
    "sizes": "select p_partkey as media_id, cast(p_size * 40 + 17 as int) as w, cast((p_partkey * 13) % 900 + 31 as int) as h from {part}",
    "scores": "select media_id, i, y from {samples}",
}


def _sql(name: str, which: int) -> str:
    sql = VIEWS[name]
    return sql if isinstance(sql, str) else sql[which]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, of the driver's data."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _sql(name, 0)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


@functools.cache
def _needed(name: str) -> tuple[str, ...]:
    if name not in VIEWS:
        return ()
    out: list[str] = []
    for n in re.findall(r"\{(\w+)\}", _sql(name, 1)):
        out += [x for x in _needed(n) if x not in out]
    return (*out, *([name] if name not in out else []))


def ctes(*names: str) -> str:
    """WITH clauses (for DuckDB) of the views and those they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in _needed(n) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', _sql(n, 1))})" for n in order) if order else ""
