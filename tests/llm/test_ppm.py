import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark.llm import ppm, queries
from tests.llm import brute
from tests.llm.test_native import ODD, SCHEMA


def close(a, b):
    return all(abs(x - y) <= 1e-6 * max(1, abs(y)) for x, y in zip(a, b))


def test_scores_on_a_whole_table(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    want = dict(zip(docs, brute.ppm([(t, brute.crc(d) % 7 != 2) for d, t in docs.items()], ppm.ORDER)))
    rows = queries.op3_ppm_scoring(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (brute.crc(r.doc_id) % 7 == 2) and close((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[r.doc_id])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [0, 2, 4])
def test_scores_random(spark, order):
    draw = random.Random(order)
    rows = [(i, "".join(draw.choice("aab c\né") for _ in range(draw.choice([0, 1, 3, 40]))), i % 3 > 0) for i in range(30)]
    rows += [(1, None, True), (1, "zzqy", False), (None, "  ", True), (2, rows[2][1], True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    got = ppm.ppm_score(docs.select("doc_id", "text", F.col("t").alias("score"), "t"), F.lit(True), order, 50).count()
    assert got == len(rows)
    by_id = spark.createDataFrame([(i, t, i % 3 > 0) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string, t boolean")
    out = ppm.ppm_score(by_id, F.col("doc_id") % 3 > 0, order, 50).collect()
    want = brute.ppm([(t, i % 3 > 0) for i, (_, t, _) in enumerate(rows)], order)
    for r in out:
        assert close((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[r.doc_id]), r


def test_edges(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert ppm.ppm_score(odd, F.col("doc_id") > 2).count() == len(ODD) and ppm.ppm_score(odd, F.lit(False)).count() == len(ODD)
    assert ppm.ppm_score(odd.limit(0), F.lit(True)).count() == 0


def test_query_keeps_its_contract_on_odd_rows(spark, tmp_path):
    rows = [(1, "a b A"), (2, None), (3, ""), (None, "a zz"), (None, None), (5, "b\x0bB \x1c c"), (6, "new é É"), (9, "a"), (9, "a"), (13, "\xa0 a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in brute.SPACE.findall(t or "")] + [None]
    held = lambda d: d is not None and brute.crc(d) % 7 == 2
    words = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(words.values()), len(words)
    want = sorted((str(d), held(d), len(tokens(t)), sum(words[w] > 0 for w in tokens(t)), n, round(sum(math.log10((words[w] + 1) / (n + 1 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in queries.op3_ppm_scoring(spark, str(tmp_path)).collect())
    assert got == want and {x[1] for x in want} == {True, False}
