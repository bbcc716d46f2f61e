"""Operators that compare documents with each other."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import jaccard_join, queries
from tests.llm import brute
from tests.llm.test_native import ODD, SCHEMA

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def texts(spark, sf=SF):
    return [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]


def test_signatures_meet_whenever_sets_are_similar():
    draw = np.random.default_rng(3)
    for percent in (80, 85):
        for n in [*range(1, 30), 50, 100, 333, 1000]:
            for _ in range(30 if n < 100 else 5):
                a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
                most = int(len(a) * (100 - percent) / 100)
                gone, new = draw.integers(0, most + 1), draw.integers(0, most + 2)
                b = np.unique(np.concatenate([a[gone:], draw.integers(0, 2**63, new, dtype=np.uint64)]))
                both = len(a) - gone
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    sigs, of = jaccard_join.all_signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                    assert len(np.intersect1d(sigs[of == 0], sigs[of == 1])), (n, gone, new)


def test_chunks_hash_each_text_by_itself(monkeypatch):
    import pyarrow as pa

    from flowspark.llm import hashing

    draw = random.Random(2)
    texts = [None, "", " ", "a", "A b", *["".join(draw.choice("ab \n\té") for _ in range(draw.randint(0, 60))) for _ in range(300)], "x y " * 200]
    want = [len(brute.shingles(t, 3)) for t in texts]
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(hashing, "CHUNK", most)
        got = []
        for raw, begin in hashing.chunks(pa.array(["skipped", *texts]).slice(1)):
            tokens, at = hashing.shingle_sets(hashing.lower(raw), begin, 3)
            got += [tuple(tokens[i:j]) for i, j in zip(at[:-1], at[1:])]
        assert [len(g) for g in got] == want
        first = got if most == 1 else first
        assert got == first


def test_jaccard_on_a_whole_table(spark):
    got = Counter(tuple(r) for r in queries.op1_ngram_jaccard(spark, SF).collect())
    assert got == brute.jaccard(texts(spark), 4, 85)


def test_jaccard_random_groups(spark, odd):
    draw = random.Random(5)
    rows = []
    for g in range(12):
        base = [draw.choice("abcdefghijklmnop") + str(draw.randint(0, 60)) for _ in range(draw.choice([1, 3, 5, 8, 14, 40, 150]))]
        for _ in range(draw.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(draw.randint(0, max(1, len(w) // 25))):
                w[draw.randrange(len(w))] = draw.choice("xyz")
            rows.append((len(rows), " ".join(w)))
    rows += [(None, rows[0][1]), (500, rows[0][1]), (500, rows[0][1]), (None, "only one such text"), (501, None), (502, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((4, 85), (5, 80)):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, size, percent).collect())
        assert got == brute.jaccard(rows, size, percent)
    kept = jaccard_join.keep_one(docs).collect()
    want = brute.jaccard(rows, 5, 80)
    assert len(kept) == len({c for (_, n, c) in want if n}) + sum(v for (_, n, _), v in want.items() if not n)
    assert Counter((r.doc_id, r.n_shingles) for r in jaccard_join.jaccard_components(odd, 4, 85).collect()) == Counter((x[0], len(brute.shingles(x[1], 4))) for x in ODD)
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0 and jaccard_join.keep_one(odd).columns == odd.columns


def test_pairs_and_meetings_go_in_waves(spark, monkeypatch):
    """A table of many pairs takes several waves, so no wave carries all sets; nothing is lost by that."""
    draw, made = random.Random(8), Counter()
    rows = []
    for _ in range(6):
        base = [f"{draw.choice('abcdefghij')}{draw.randint(0, 40)}" for _ in range(draw.choice([20, 60]))]
        for _ in range(8):
            w = list(base)
            for _ in range(draw.randint(0, 4)):
                w[draw.randrange(len(w))] = draw.choice("xyz")
            rows.append((len(rows), " ".join(w)))
    cut = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df, name: made.update([name]) or cut(df, name))
    assert [jaccard_join._waves(n, 10.0) for n in (0, 1, 10, 11, 95)] == [1, 1, 1, 2, 10] and jaccard_join._waves(5, 0.0) == 5
    monkeypatch.setattr(jaccard_join, "_waves", lambda carried, most: 3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == brute.jaccard(rows, 4, 85)
    assert made["jaccard-links"] >= 3 and made["jaccard-links"] % 3 == 0 and made["jaccard-wide"] == 3, made


def test_keep_one_does_not_mix_components_under_null_or_repeated_ids(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(None, one), (None, two), (None, two + " more"), (7, three), (7, four), (8, four)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in kept) == {None: 2, 7: 2}
    assert {(None, one), (7, three), (7, four)} < {tuple(r) for r in kept}


def test_repeats_on_a_whole_table(spark):
    got = Counter(tuple(r) for r in queries.op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == brute.repeats(texts(spark, "/root/testdata/sf0.001"))


def test_repeats_random(spark, odd):
    from flowspark.llm import suffix_dedup

    draw = random.Random(9)
    line = lambda n, letters="ab é": "".join(draw.choice(letters) for _ in range(n))
    shared = [line(n) for n in (60, 99, 100, 101, 130, 260, 700)]
    rows = [(i, "".join(draw.choice([draw.choice(shared), line(draw.randint(0, 90)), "x" * draw.randint(0, 300), "ab" * draw.randint(0, 120)]) for _ in range(draw.randint(0, 6)))) for i in range(120)]
    rows += [(7000, shared[6]), (7000, shared[6]), (None, shared[6]), (None, None), (8000, "z" * 99), (8001, "z" * 99), (8002, "z" * 100), (8003, "z" * 5000)]
    out = suffix_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r)[:5] for r in out.collect()) == brute.repeats(rows)
    assert Counter(tuple(r)[:5] for r in suffix_dedup.dedup_spans(odd).collect()) == brute.repeats([x[:2] for x in ODD])
    assert suffix_dedup.dedup_spans(odd.limit(0)).count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    """op7 fills the disks by what its steps shuffle: what a finished step has shuffled must not wait for a collection."""
    import time

    from flowspark.llm import common

    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    df = spark.range(10_000).selectExpr("id % 77 as k").repartition(5, "k").groupBy("k").count()
    out = common.cut(df, "test")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and out.count() == 77
