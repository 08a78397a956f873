"""Queries whose tasks must not grow with their tables, and pages whose text is cut."""

import math
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from lumenspan.operators import boxes, series, similarity, skew, timejoin
from lumenspan.plans.registered import QUERIES


def test_clean_text_leaves_open_entities_of_pages(spark, tmp_path):
    odd = ["<title>A &amp;amp; B &amp;amp</title>", "x &amp &amp;quot &lt y &", "&amp;amp;lt; &unknown; &copy;&copy", "&#", None]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    f, sql = QUERIES["clean_text"]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(sql).fetchall()
    assert sorted(tuple(r) for r in f(spark, str(tmp_path)).select("page_id", "text").collect()) == sorted(want)


def test_ontology_probs_shuffles_vectors_only_and_sums_over_repeated_ids(spark, capsys):
    nan = float("nan")
    vectors = [("a", 1, [1.0, 2.0]), ("a", 1, [2.0, -1.0]), ("a", 2, [0.0, 0.0]), ("b", 1, [3.0, 4.0]), ("b", 2, [1.0, 2.0, 3.0]), ("b", 3, None), ("b", 4, [1.0, None]), ("b", 5, [nan, 1.0]), ("b", 6, [])]
    emb = spark.createDataFrame(vectors, "media_id string, id long, embedding array<double>")
    concepts = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.5, -2.0]), (9, [1.0, 0.0, 0.0])], "concept long, embedding array<double>")
    found = similarity.ontology_probs(emb, concepts, 3.0)
    found.explain()
    assert not any("concept" in line for line in capsys.readouterr().out.splitlines() if "Exchange" in line)
    unit = lambda v: [0.0 if not (n := math.sqrt(sum(x * x for x in v))) else x / n for x in v] if v and None not in v else [0.0] * len(v or [])
    z = [(m, i, c, None if v is None or len(v) != len(w) else 3 * sum(x * y for x, y in zip(unit(v), unit(w), strict=True))) for m, i, v in vectors for c, w in [(r.concept, r.embedding) for r in concepts.collect()]]
    total = {}
    for m, i, _, x in z:
        total[m, i] = total.get((m, i), 0.0) + (0.0 if x is None else math.exp(x))
    want = sorted((m, i, c, "null" if x is None else f"{math.exp(x) / total[m, i]:.9f}") for m, i, c, x in z)
    assert sorted((r.media_id, r.id, r.concept, "null" if r.y is None else f"{r.y:.9f}") for r in found.collect()) == want


def test_interpolate_has_tasks_of_so_many_rows(spark, monkeypatch):
    rows = [(f"m{m}", "x", float(t), float(t * m) if t % 3 else None) for m in range(30) for t in range(20)]
    df = spark.createDataFrame(rows, "media_id string, label string, time double, y double")
    want = sorted(map(tuple, series.interpolate(df, df).collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    found = series.interpolate(df, df)
    assert found.rdd.getNumPartitions() == 12  # 600 knots and 600 places
    assert sorted(map(tuple, found.collect())) == want
    assert [r[3] for r in want if r[0] == "m2"] == [2.0, *(2.0 * t for t in range(1, 20))]


def test_face_size_filter_has_tasks_of_so_many_boxes(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    b = spark.range(1000).select("id", (F.col("id") % 500).alias("ref_id"), (F.col("id") / 1000).alias("h"))
    out = boxes.face_size_filter(b, spark.range(600), spark.range(700).withColumn("ref_id", F.col("id")), min_height=0.9)
    assert {name: df.rdd.getNumPartitions() for name, df in out.items()} == {"boxes": 10, "faces": 10, "images": 10}
    assert {name: df.count() for name, df in out.items()} == {"boxes": 200, "faces": 100, "images": 100}


def test_optional_inputs_has_tasks_of_so_many_boxes(spark, tmp_path, monkeypatch):
    spark.range(300).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus")).write.parquet(str(tmp_path / "orders.parquet"))
    line = {"l_orderkey": "id div 3", "l_linenumber": "cast(id % 3 as int)", "l_partkey": "id", "l_suppkey": "id", "l_quantity": "cast(id % 50 as double)", "l_discount": "0.1d"}
    spark.range(900).select(*(F.expr(e).alias(c) for c, e in line.items())).write.parquet(str(tmp_path / "lineitem.parquet"))
    f, sql = QUERIES["optional_inputs"]
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    found = f(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 36  # of each of its four parts 9
    with duckdb.connect() as con:
        for name in ("orders", "lineitem"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = con.execute(sql).fetchall()
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


def test_face_crops_sorts_keypoints_in_tasks_of_so_many(spark, monkeypatch, capsys):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    k = spark.range(900).select((F.col("id") % 300).alias("ref_id"), F.array("id").alias("x"), F.array("id").alias("y"), F.col("id").alias("seq"))
    found = timejoin.face_crops(spark.range(50), spark.range(300).withColumn("ref_id", F.col("id") % 100), k)
    found.explain()
    assert "hashpartitioning(ref_id" in (out := capsys.readouterr().out) and ", 9), REPARTITION_BY_NUM" in out
    assert sorted((r.face_id, r.image_id, r.x) for r in found.collect()) == [(f, f % 100, [600 + f]) for f in range(300) if f % 100 < 50]


def stored(spark, tmp_path, name):
    """The rows of a query on documents in four files, and how many files each folder that it wrote has."""
    texts = [(i, "text %d " % (i % 30) + "x" * (i % 7 * 600)) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir()) if shared.is_dir() else set()
    f, sql = QUERIES[name]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = sorted(map(tuple, f(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset(coalesce)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == sorted(con.execute(sql).fetchall())
    [path] = [p for p in set(shared.iterdir()) - before if p.name.startswith(name.split("_")[0])]
    return {str(p.relative_to(path)): len(list(p.glob("*.parquet"))) for p in (*path.glob("all/*=*"), *path.glob("in/*"))}


def test_ingest_stream_gathers_no_turn_in_one_task(spark, tmp_path):
    files = stored(spark, tmp_path, "ingest_stream")
    assert len(files) == 6 and min(files.values()) > 1


def test_reassemble_stream_gathers_no_turn_in_one_task(spark, tmp_path):
    files = stored(spark, tmp_path, "reassemble_stream")
    assert len(files) == 8 and min(files.values()) > 1
