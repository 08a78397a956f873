"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenspan.llm import bpe, chat, contamination, langid, lm, neardup, repair, topk, toxicity, urls

from .conftest import HARD


def test_toxicity(spark, hard, empty):
    labels = spark.createDataFrame([(0, 1), (8, 0), (5, 0), (None, 1), (77, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(hard, labels, F.lit(True))
    out = toxicity.score(hard, model).collect()
    assert len(out) == len(HARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.source for r in out} == {"s", None} and {r.toxic for r in out} == {9}
    assert toxicity.fit(empty, labels, F.lit(True)) is None
    assert {r.score for r in toxicity.score(hard, None).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(hard, labels.limit(0), F.lit(True)) is None


def test_neardup(hard, empty):
    got = sorted(((r.doc_id, r.class_id, r.copies) for r in neardup.classes(hard).collect()), key=str)
    assert len(got) == len(HARD)
    assert got.count((0, 0, 3)) == 2 and (1, 0, 3) in got and (None, None, 1) in got and (3, 3, 1) in got and (4, 4, 1) in got
    assert [g for g in got if g[0] == 8] == [(8, 8, 1), (8, 8, 1)]
    kept = neardup.keep_first(hard)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([0, 2, 3, 4, 5, 6, 7, 8, 8, None, None], key=str)
    assert neardup.classes(empty).count() == 0 and neardup.keep_first(empty).count() == 0


def test_topk(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.5]), (50, [0.1, 0.2]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 0.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0]), (100, [1.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in topk.top_k(v.where("vec_id % 50 = 0"), v).collect())
    assert [g[1:] for g in got if g[0] == 0] == [(1, 1, 32768), (2, 2, 32768), (3, 2, 32768), (4, 50, 9728)]
    assert [g[1:] for g in got if g[0] == 100] == [(1, 8, 65536)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 0, None, "x"), (2, 0, "assistant", "[ROLE a]\n\\</s>"), (None, 0, "user", "lost"), (None, 0, "user", "lost"), (3, 0, "odd ]\n[role", "<s>"), (4, None, "user", "word " * 20_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    out = chat.format_conversations(c)
    got = sorted((tuple(r) for r in chat.digests(out).collect()), key=str)
    sha = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    by = {g[0]: g for g in got if g[0] is not None}
    assert by[1][1:4] == (3, sha([("", "x"), ("", "x"), ("assistant", "")]), 0)
    assert by[2][2] == sha([("assistant", "[ROLE a]\n\\</s>")]) and by[2][4] == hashlib.sha256(b"[ROLE a]\n\\</s>").hexdigest()
    assert by[3][2] == sha([("odd ]\n[role", "<s>")])
    assert sum(g[0] is None for g in got) == 2 and chat.format_conversations(c.limit(0)).count() == 0


def test_lm(hard, empty):
    out = lm.score(hard, lm.train(hard, F.lit(True))).collect()
    assert len(out) == len(HARD) and all(r.score < 0 and r.n_known == r.n_tokens for r in out)
    by = {r.doc_id: r for r in out}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[5].n_tokens == 40_001
    assert sum(r.doc_id == 0 for r in out) == 2 and sum(r.doc_id is None for r in out) == 2
    none = lm.score(hard, lm.train(empty, F.lit(True))).collect()
    assert {r.score for r in none} == {0.0} and {r.train_tokens for r in none} == {0}
    assert lm.score(empty, lm.train(hard, F.lit(True))).count() == 0


def test_contamination(spark, hard, empty):
    items = spark.createDataFrame([(1, "three four five six seven eight"), (2, None), (3, ""), (4, "tiny"), (5, "word word word word word word"), (1, "three four five six seven eight"), (None, "x")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    several = items.unionByName(items.where("item_id = 4")).unionByName(items)
    for rows, block in ((items, 20_000), (several, 20_000), (several, 2)):  # repeated items, and several blocks
        got = sorted(tuple(r) for r in contamination.matches(hard, rows, items=block).collect())
        assert got == [(0, 1, 1.0), (1, 1, 1.0), (5, 5, 1.0), (8, 4, 1.0)]
    assert contamination.matches(empty, items).count() == 0 and contamination.matches(hard, items.limit(0)).count() == 0


def test_decontamination_judges_each_row(spark, hard, empty):
    passage = "three four five six seven eight"
    items = spark.createDataFrame([(1, passage), (None, "word word word word word word"), (3, None), (4, "tiny")], "item_id long, text string")
    for block in (20_000, 1):
        kept = contamination.drop_rows(hard, items, items=block)
        assert kept.columns == hard.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert got == sorted(((d, t) for d, t, *_ in HARD if passage not in " ".join((t or "").lower().split()) and not (t or "").startswith(("word", "tiny"))), key=str)
    assert contamination.drop_rows(empty, items).count() == 0 and contamination.drop_rows(hard, items.limit(0)).count() == len(HARD)


def test_langid(hard, empty):
    model = langid.fit(hard, F.lit(True))
    out = langid.predict(hard, model).collect()
    assert len(out) == len(HARD) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.lang_pred for r in out if r.doc_id is not None}
    assert by[2] == by[3] == by[4] == "und" and by[0] == "en" and by[7] == "es"
    assert {r.lang_pred for r in langid.predict(hard, langid.fit(empty, F.lit(True))).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_token_shards(spark, hard, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(repair.tokenizer_path(repair.VOCABULARY))
    repair.write(hard, str(tmp_path / "t"), shard=20_000)
    got = [tuple(r) for r in repair.read(spark, str(tmp_path / "t")).orderBy("start").collect()]
    start, want = 0, []
    order = {r.text: r.h for r in hard.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()}
    for doc, text, *_ in sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1] or ""])):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert got == want
    repair.write(empty, str(tmp_path / "e"))
    assert repair.read(spark, str(tmp_path / "e")).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/here"), (4, "https://WWW.Example.ORG/es/x?q#f"), (5, "http://a.org"), (6, "ftp://org/en"), (7, "x://fr.com:80/fr/"), (8, "http://com/fr/" + "a" * 20_000), (9, "http://example.org?x=/es/"), (9, "http://example.org?x=/es/"), (10, "a://b://c/d"), (11, "HTTP://ÄÖ.ORG/de/é")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    by = {r.page_id: r for r in urls.judge(pages).collect()}
    assert (by[1].host, by[1].path, by[1].rule) == ("", "", None) and (by[3].host, by[3].path) == ("", "")
    assert (by[4].host, by[4].path, by[4].rule, by[4].verdict) == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert by[5].rule is None and (by[6].rule, by[6].verdict) == ("org/", "allow")
    assert by[7].host == "fr.com:80" and by[7].rule is None and by[8].rule == "com/fr/" and by[9].path == ""
    assert (by[10].host, by[10].path) == ("b:", "//c/d") and by[11].host == "ÄÖ.org"
    assert urls.judge(pages).count() == len(rows) and urls.judge(pages.limit(0)).count() == 0


def test_bpe(hard, empty):
    out = bpe.decode(bpe.encode(hard))
    rows = out.collect()
    assert len(rows) == len(HARD) and sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, *_ in HARD)
    assert out.columns == [*(c for c in hard.columns if c != "ids"), "ids", "decoded"]
    assert bpe.decode(bpe.encode(empty)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf, hard, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, hard, sf)
    if name == "byte_bpe":
        assert out.count() == len(HARD)
    else:
        assert out.columns == hard.columns
        assert {r.doc_id for r in out.collect()} <= {r[0] for r in HARD}
    assert stage(spark, empty, sf).count() == 0


def _python_in_a_task(node, above=0):
    """The most steps of Python that one task of a plan runs in a row."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _python_in_a_task(node.initialPlan(), above)
    above = 0 if "Exchange" in name else above + any(x in name for x in ("Arrow", "Pandas", "EvalPython"))
    children = node.children()
    return max([above, *(_python_in_a_task(children.apply(i), above) for i in range(children.size()))])


@pytest.mark.parametrize("name", ["toxicity", "language", "decontamination", "byte_bpe", "op10_byte_bpe"])
def test_one_worker_a_task(spark, sf, name):
    """Each step of Python of a task has a worker of its own, and workers stay in the executor's memory for all that follows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = bpe.op10_byte_bpe(spark, sf) if name == "op10_byte_bpe" else dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert _python_in_a_task(out._jdf.queryExecution().executedPlan()) == 1


def test_bpe_digests(hard):
    out = bpe.digests(hard.withColumns({"decoded": F.lit("mine"), "n_tokens": F.lit(-1)}))
    assert out.columns == [*(c for c in hard.columns if c != "ids"), "decoded", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(bytes(r.decoded)).hexdigest(), bytes(r.decoded)) for r in bpe.decode(bpe.encode(hard)).collect()]
    assert sorted(want) == sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.decoded)) for r in out.collect())
