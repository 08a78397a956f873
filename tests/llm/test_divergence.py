"""The divergence audit against counting in dictionaries, its runs, and hard rows."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import divergence

from .conftest import HARD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least):
    """(lang, source, part, item, value, rank) of rows (text, lang, source), in Python's integers."""
    tf, df, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate(LOWER))
        for w in words:
            tf[lang, source, w] += 1
        for w in set(words):
            df[lang, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        terms = [w for (x, w), n in df.items() if x == lang and n >= least]
        sources = [s for x, s in groups if x == lang]
        share = lambda count: {w: 1 + 10**9 * (count(w) + 2) // (sum(map(count, terms)) + 2 * len(terms)) for w in terms}
        p = {s: share(lambda w, s=s: tf[lang, s, w]) for s in sources}
        q = share(lambda w: sum(tf[lang, s, w] for s in sources))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(t, sum(f(p[s][w], p[t][w]) for w in terms)) for t in sources if t != s]
            term = [(w, f(p[s][w], q[w])) for w in terms if tf[lang, s, w] and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= divergence.TOP]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("cells", [divergence.CELLS, 40])
def test_audit_by_hand(spark, cells):
    rng = np.random.default_rng(3)
    words = ["Ab", "aB", "z", "é", "漢字", "x1y", "\U0001f600", *(f"w{chr(97 + i)}{'x' * j}" for i in range(20) for j in range(4))]
    share = 1 / np.arange(1, len(words) + 1)
    rows = [(" ,".join(rng.choice(words, int(rng.integers(0, 40)), p=share / share.sum())), str(rng.choice(["en", "de"])), f"s{min(int(rng.integers(0, 12)), 5)}") for _ in range(400)]
    rows += [("only once", "en", "rare"), (None, "en", "none"), ("a b", "fr", "alone"), ("", "xx", "p"), ("q", "xx", "q")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert rows_of(divergence.audit(docs, cells=cells)) == by_hand(rows, 10)


def test_audit_of_hard_rows(hard, empty):
    want = by_hand([(t, lang, s) for _, t, lang, s, _ in HARD], 2)
    assert rows_of(divergence.audit(hard, least=2)) == want
    assert {r[:2] for r in want} == {("", ""), ("", "s"), ("en", ""), ("en", "s")}  # one source alone has no pair
    assert divergence.audit(empty).count() == 0


def test_terms_stay_inside_texts():
    texts = pa.array(["ab", "cd", "", "É1é", "\0x", "a" * 70_000], pa.string()).slice(1)
    doc, code, terms = divergence.terms_of(texts)
    assert list(zip(doc.tolist(), [terms[c].as_py() for c in code.tolist()], strict=True)) == [(0, "cd"), (2, "É"), (2, "é"), (3, "x"), (4, "a" * 70_000)]
    assert len(divergence.terms_of(pa.array(["", " "], pa.string()))[1]) == 0


def test_runs_give_the_sum_of_all_terms():
    rng = np.random.default_rng(5)
    counts = rng.geometric(0.5, (300, 4)) - 1
    times = rng.integers(1, 9, 300)
    totals = [int((counts[:, s] * times).sum()) + 2 * int(times.sum()) for s in range(4)]
    runs = divergence.encode(counts, times, totals)
    assert len(runs[0].ends) < 20  # the column that leads the order has a run for each count
    for s in range(4):
        for t in range(4):
            want = sum(n * ((p - q) ** 2 // (p + q)) for n, p, q in zip(times.tolist(), *(divergence.shares(counts[:, x], totals[x]).tolist() for x in (s, t)), strict=True))
            assert runs[s].difference(runs[t]) == want
    huge = np.array([0, 10**12], np.int64)
    assert divergence.shares(huge, 10**13).tolist() == [1 + 10**9 * 2 // 10**13, 1 + 10**9 * (10**12 + 2) // 10**13]


def test_large_counts_in_sql(spark):
    got = spark.range(1).select(divergence._share(F.lit(10**12), F.lit(10**13)).alias("p")).first().p
    assert got == 1 + 10**9 * (10**12 + 2) // 10**13
