"""Operators that pass once over each text: classifier, decontamination, byte-level BPE."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from flowspark.llm import byte_bpe, decontamination, quality_model, queries
from tests.llm import brute
from tests.llm.test_native import ODD, SCHEMA

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def tik():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_leaks_on_a_whole_table(spark):
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    some = 0
    for r in queries.op8_benchmark_decontamination(spark, SF).collect():
        n, hit, found = brute.leaks(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), len(found) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        some += bool(found)
    assert some


@pytest.mark.parametrize("block", [8, 30, 10_000])
def test_leaks_random(spark, odd, block):
    draw = random.Random(block)
    line = lambda n: " ".join(draw.choice("ab") for _ in range(n))
    items = [(i, line(draw.choice([0, 1, 2, 5, 7, 8, 9, 20]))) for i in range(12)] + [(None, "A b-a"), (3, None), (3, line(9))]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1 or draw.random() < 0.5]
    texts = [(i, line(draw.randint(0, 40))) for i in range(40)] + [(None, None), (1, "Ab, é!")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan_items(docs, bench, 8, block).collect()
    named = [("" if i is None else i, t) for i, t in items]
    for r, (_, t) in zip(sorted(got, key=str), sorted(texts, key=lambda x: str(next(g for g in got if (g.doc_id, g.text) == x)))):
        n, hit, found = brute.leaks(r.text, named)
        flat = list(r["__runs"])
        assert (r["__n"], sum(flat[1::2]) - sum(flat[::2]), sorted(r["__items"])) == (n, hit, found)
    assert decontamination.match_items(odd, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.match_items(odd.limit(0), bench).count() == 0


def test_contamination_is_cut_out(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    rows = [(1, "Lead-in words stay here: one two three, FOUR five six seven eight. And these words stay as well, é.", "x"), (2, "one two three four five six seven eight", "x"), (3, None, None), (4, "one two three four five six seven", "x")]
    out = {r.doc_id: r for r in decontamination.remove_contamination(spark.createDataFrame(rows, "doc_id long, text string, __n string"), bench, max_coverage=0.6).collect()}
    assert set(out) == {1, 3, 4} and out[1].text == "Lead-in words stay here: . And these words stay as well, é." and out[1]["__n"] == "x" and out[4].text == rows[3][1]


def test_bpe_on_a_whole_table(spark, tik):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    for r in queries.op9_byte_bpe(spark, SF).collect():
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_edges(spark, odd, tik):
    rows = byte_bpe.encode(odd, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.n_tokens, r.ids, bytes(r.decoded)) for r in rows) == sorted((len(i := tik.encode_ordinary(x[1] or "")), " ".join(map(str, i)), (x[1] or "").encode()) for x in ODD)
    assert byte_bpe.encode(odd.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    own = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    draw = random.Random(7)
    for alphabet in ("ab", "abcdefgh", "é𝄞ß", "the in", "\x1c   ", "0a'sS"):
        text = "".join(draw.choice(alphabet) for _ in range(2500))
        assert [int(i) for p in own.pieces([text])[0] for i in own.kept[p][0].split()] == tik.encode_ordinary(text)
        word = text[:700].encode()
        own.kept.clear()
        own._query([("w", word)])
        assert own._long(word) == own.kept.pop("w") and own._long(word)[1] == word


def test_classifier_holds_out_and_tells_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    rows = queries.op4_quality_classifier(spark, sf).collect()
    assert len(rows) == queries.table(spark, sf, "documents").count() and all(r.held_out == (brute.crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    again = {r.doc_id: r.score for r in queries.op4_quality_classifier(spark, sf).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_classifier_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.score_quality(odd, none, F.lit(True), F.lit(False)).collect()} == {0.5}
    few = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    assert quality_model.score_quality(odd, few, F.lit(True), F.lit(False)).count() == len(ODD)
    assert quality_model.score_quality(odd.limit(0), few, F.lit(True), F.lit(False)).count() == 0
    assert quality_model.drop_low_quality(odd, few).columns == odd.columns


def test_low_quality_is_judged_by_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents").select("doc_id", "text"), queries.table(spark, sf, "labels")
    gone = docs.join(quality_model.drop_low_quality(docs, labels), "doc_id", "left_anti").join(labels.filter("quality = 0"), "doc_id").select("text").first().text
    good = [r.text for r in docs.join(labels.filter("quality = 1"), "doc_id").select("text").limit(2).collect()]
    own = spark.createDataFrame([(None, gone), (None, good[0]), (-5, gone), (-5, good[1])], "doc_id long, text string")
    kept = [tuple(r) for r in quality_model.drop_low_quality(docs.unionByName(own), labels).collect()]
    assert {r for r in kept if r[0] in (None, -5)} == {(None, good[0]), (-5, good[1])}


def test_pooling_is_isotonic():
    draw = np.random.default_rng(1)
    x = np.sort(draw.normal(size=200))
    s, p = quality_model.pool(x, (draw.random(200) < 0.5) * 1.0, np.ones(200))
    assert (np.diff(p) > 0).all() and (np.diff(s) > 0).all()


def test_scores_match_one_plain_solution(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    stats = {d: np.array(quality_model.statistics(t or "")) for d, t in docs.items()}
    part = lambda fold: [d for d in docs if d in labels and fold(brute.crc(d) % 5)]
    fit, calibrate = part(lambda f: f not in (0, 4)), part(lambda f: f == 4)
    x = np.array([stats[d] for d in fit])
    project = quality_model.Projection(x.mean(0), np.sqrt(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 1e-8)))
    of = lambda ids: (np.array([stats[d] for d in ids]), np.array([float(labels[d]) for d in ids]))
    want = brute.quality(*of(fit), *of(calibrate), np.array([stats[d] for d in docs]), project, quality_model.BINS, quality_model.RIDGE)
    got = {r.doc_id: r.score for r in queries.op4_quality_classifier(spark, SF).collect()}
    assert max(abs(got[d] - w) for d, w in zip(docs, want)) < 1e-5
