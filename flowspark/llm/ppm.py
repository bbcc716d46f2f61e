"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER long, pretrained on the training documents. A symbol that followed a
context c times out of C, with T different symbols, has probability c / (C + T); otherwise the model escapes with
T / (C + T) to the context without its first byte, where symbols that the longer context has seen are excluded from all
counts; below order 0 the 256 codes share what is left. A text is its bytes and one end code (0xFF, which UTF-8 never
uses), after ORDER start codes (0xFE).

The trie is never on one machine. Blocks of documents give their distinct grams (context and symbol) with training
counts; tables of grams, one for each order, are joined from short contexts to long, which gives every gram that
occurs anywhere its code length; each block gets back the code lengths of its own grams. So what moves grows with the
text, no model is broadcast, and nothing about the corpus reaches the driver but totals. Words for the base score
travel the same way, as 64-bit hashes: 1e9 different words hold a false match with a chance of 3 %. A word that came c
times among N training tokens, V of them different, has the base probability (c + 1) / (N + V + 1): one more each, and
one word for all that training never met.

Nulls: a null text is empty: one end. A row without doc_id trains by the value of `trains`. Repeated rows train as often
as they stand there, and each gets a row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, row_key
from .hashing import chunks, lower, words_of

ORDER = 4
START, END = 0xFE, 0xFF
BLOCK = 24_000_000
END_WORD = 0  # the key of the end token among the words' hashes


def grams(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each symbol of the texts that begin at `at` in raw, packed in a long, and where each text's begin."""
    k, size = len(at) - 1, np.diff(at)
    a = np.full(len(raw) + k * (order + 1), START, dtype=np.uint8)
    a[np.arange(len(raw)) + np.repeat(np.arange(k) * (order + 1) + order, size)] = raw
    after = at[1:] + np.arange(1, k + 1) * (order + 1)
    a[after - 1] = END
    a = a.astype(np.int64)
    g = np.zeros(max(0, len(a) - order), dtype=np.int64)
    for j in range(order + 1):
        g = g << 8 | a[j : len(a) - order + j]
    inside = np.ones(len(a), dtype=bool)
    inside[(after[:, None] - 1 - np.arange(order)[None, :]).ravel()] = False  # would span two texts
    return g[inside[: len(g)]], np.cumsum(size + 1) - (size + 1)


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all pairs (keys, counts) and the sums of their counts."""
    keys, at = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[k for k, _ in pairs]]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([np.zeros(0), *[n for _, n in pairs]]), len(keys)).astype(np.int64)


def _gather(order: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        found = {(w, x): [] for w in (False, True) for x in (False, True)}  # by kind of key and training
        block, ends = key[0].as_py(), 0
        for b in table.to_batches(max_chunksize=1000):
            trains = b.column("trains")
            ends += trains.true_count
            for x in (True, False):
                for raw, at in chunks(b.column("text").filter(trains if x else pa.compute.invert(trains))):
                    found[False, x].append(np.unique(grams(raw, at, order)[0], return_counts=True))
                    found[True, x].append(np.unique(words_of(lower(raw), at)[0].view(np.int64), return_counts=True))
        out = [_rows(block, True, np.array([END_WORD]), np.array([ends]))]
        for word in (False, True):
            known, other = _added(found[word, True]), _added(found[word, False])
            only = np.setdiff1d(other[0], known[0], assume_unique=True)
            out.append(_rows(block, word, np.concatenate([known[0], only]), np.concatenate([known[1], np.zeros(len(only), dtype=np.int64)])))
        return pa.Table.from_batches(out)

    return work


_ROWS = pa.schema([("block", pa.int32()), ("word", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])


def _rows(block: int, word: bool, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block, dtype=np.int32)), pa.array(np.full(len(n), word)), pa.array(keys), pa.array(n)], schema=_ROWS)


def code_lengths(counts: DataFrame, order: int) -> DataFrame:
    """gram and p, the log10 probability of its symbol after its context, of every gram in counts (gram, n)."""
    levels = {order: counts}
    for k in range(order - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
    context = F.expr("shiftright(gram, 8)").alias("context")
    below = None
    for k in range(order + 1):
        rows = levels[k]
        if below is None:
            rows = rows.withColumns({"low": F.lit(None).cast("double"), "p_low": F.lit(None).cast("double"), "n_low": F.lit(0).cast("long"), "c_low": F.lit(0).cast("long"), "t_low": F.lit(0).cast("long")})
        else:
            short = below.select(F.col("gram").alias("short"), F.col("n").alias("n_low"), F.col("c").alias("c_low"), F.col("t").alias("t_low"), "low", F.col("p").alias("p_low"))
            rows = rows.withColumn("short", F.col("gram").bitwiseAND((1 << 8 * k) - 1)).join(short, "short").drop("short")
        total = rows.groupBy(context).agg(F.sum("n").alias("c"), F.sum((F.col("n") > 0).cast("long")).alias("t"), F.sum(F.when(F.col("n") > 0, F.col("n_low")).otherwise(0)).alias("x"))
        rows = rows.withColumn("context", context).join(total, "context").drop("context")
        # low: the symbol's log10 probability once this context is escaped from, its symbols excluded below
        c, t = F.col("c_low") - F.col("x"), F.col("t_low") - F.col("t")
        if below is None:
            low = -F.log10(F.greatest(F.lit(256) - F.col("t"), F.lit(1)).cast("double"))
        else:
            escape = F.when(c + t > 0, F.log10(t / (c + t))).otherwise(0.0)
            low = F.when(F.col("n_low") > 0, F.log10(F.col("n_low") / (c + t))).otherwise(escape + F.col("low"))
        rows = rows.withColumn("low_now", F.when(F.col("n") == 0, low))
        p = F.when(F.col("c") == 0, F.col("p_low") if below is not None else F.lit(-np.log10(256))).when(F.col("n") > 0, F.log10(F.col("n") / (F.col("c") + F.col("t")))).otherwise(F.log10(F.col("t") / (F.col("c") + F.col("t"))) + F.col("low_now"))
        # a context never seen passes its symbol's escape on from below
        rows = rows.withColumn("p", p).select("gram", "n", "c", "t", F.when(F.col("c") == 0, F.col("low") if below is not None else F.lit(-np.log10(256))).otherwise(F.col("low_now")).alias("low"), "p")
        below = cut(rows, f"ppm-order{k}") if k < order else rows
    return below.select("gram", "p")


def _score(order: int):
    def work(key: tuple, left: pa.Table, back: pa.Table) -> pa.Table:
        done = []
        word = back.column("word").to_numpy()
        keys, p, known = back.column("key").to_numpy(), back.column("p").to_numpy(), back.column("known").to_numpy()
        gram_at, gram_p = pd.Index(keys[~word]), p[~word]
        word_at, word_p, word_known = pd.Index(keys[word]), p[word], known[word].astype(np.int64)
        end = word_at.get_loc(END_WORD)
        for b in left.to_batches(max_chunksize=1000):
            upto = 0
            for raw, at in chunks(b.column("text")):
                n = len(at) - 1
                own, start = grams(raw, at, order)
                score = np.add.reduceat(gram_p[gram_at.get_indexer(own)], start)
                words, begin = words_of(lower(raw), at)
                count = np.diff(begin)
                place, of = word_at.get_indexer(words.view(np.int64)), np.repeat(np.arange(n), count)
                base = np.bincount(of, word_p[place], n) + word_p[end]
                seen = np.bincount(of, word_known[place], n).astype(np.int64) + word_known[end]
                doc_id, trains = (b.column(c).slice(upto, n) for c in ("doc_id", "trains"))
                done.append(pa.RecordBatch.from_arrays([doc_id, trains, pa.array(count + 1, pa.int64()), pa.array(seen), pa.array(base), pa.array(score)], names=["doc_id", "trains", "n_tokens", "n_known", "base_score", "score"]))
                upto += n
        return pa.Table.from_batches(done)

    return work


def ppm_score(docs: DataFrame, trains: Column, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """doc_id, trains, n_tokens, n_known, train_tokens, base_score and score of each row."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce(trains, F.lit(False)).alias("trains"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Blocks are chosen by content, so that both passes agree.
    place = F.pmod(row_key(F.col("doc_id"), F.col("text")), F.lit(max(1, -(-size // block)))).cast("int")
    rows = rows.withColumn("block", place)
    found = cut(rows.groupBy("block").applyInArrow(_gather(order), "block int, word boolean, key long, n long"), "ppm-found")
    counts = found.filter("not word").groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n"))
    lengths = code_lengths(cut(counts, "ppm-grams"), order)
    words = cut(found.filter("word").groupBy("key").agg(F.sum("n").alias("n")), "ppm-words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    scored = words.select("key", (F.col("n") > 0).alias("known"), F.log10((F.col("n") + 1) / F.lit(float(total + kinds + 1))).alias("p"))
    back = found.filter("not word").select("block", "word", "key").join(lengths.select(F.col("gram").alias("key"), F.lit(True).alias("known"), "p"), "key")
    back = back.unionByName(found.filter("word").select("block", "word", "key").join(scored, "key")).select("block", "word", "key", "known", "p")
    both = rows.groupBy("block").cogroup(back.groupBy("block"))
    out = both.applyInArrow(_score(order), rows.select("doc_id", "trains", *[F.lit(0).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))]).schema)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
