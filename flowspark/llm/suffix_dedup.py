"""Exact removal of repeated byte strings, by sorting one suffix bucket at a time with cover-sample ranks.

Every window of `SPAN` bytes that also starts earlier is removed. A window's bucket is chosen by its own content: the
least hash among its runs of GRAM bytes (the leftmost of equals) is its anchor, so equal windows share an anchor at one
offset, and only anchors that occur twice matter. Around those anchors go fragments, each of the windows that
the anchor owns; equal fragments go on once, with their earliest place. A task takes the anchors of its partition in
order, and sorts the suffixes of one bucket (one offset to the anchor) at a time. Text is aligned by the anchor, so a
difference cover of period CELL needs one residue: ranks of the sample positions are precomputed by doubling
(8, 16, 32, 64, then 88 bytes), and a long tie is settled by the fewer than CELL bytes before the next sample
position, its rank, and the rest.

What one anchor gathers in a task is its distinct surroundings, not its copies. Equal texts are handled as one text:
its first row keeps what is left, the others lose all of 100 or more bytes.

Nulls: a null text is empty; rows with a null doc_id come last. Of rows with equal doc_id the text's hash decides; of
equal rows one is first. Each row gets a result. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick
from .hashing import mix, windows

SPAN, GRAM, CELL = 100, 32, 8
ROOM = SPAN - GRAM  # the largest offset of an anchor in its window
WIDTH, ANCHOR = 176, 72  # of an aligned fragment, and where its anchor stands
CHUNK = 60_000


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors and position << 14 | largest offset << 7 | least offset, over all windows of a text."""
    if len(raw) < SPAN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = windows(raw, GRAM)
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    least, width = low, 1
    while width * 2 <= ROOM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = ROOM + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    end = np.concatenate([start[1:], [len(owner)]]) - 1
    pos = owner[start]
    return h[pos].view(np.int64), pos << 14 | (pos - start) << 7 | (pos - end)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that a batch holds twice are known to repeat: they go with a salt of their own, and only the first of them
    once more with salt 0, where it meets those of other batches. So a hot anchor brings its meeting one row a batch."""
    seen: set[int] = set()  # texts of this partition
    for b in batches:
        out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
        for uid, t in zip(b.column(0).to_pylist(), b.column(1)):
            if uid not in seen:
                seen.add(uid)
                h, at = anchors(np.frombuffer((t.as_py() or "").encode(), dtype=np.uint8))
                for x, y in zip(out, (h, np.full(len(h), uid), at)):
                    x.append(y)
        h, uid, at = (np.concatenate(x) for x in out)
        order = np.argsort(h, kind="stable")
        as_before = np.concatenate([[False], h[order][1:] == h[order][:-1]])[: len(h)]
        as_next = np.concatenate([as_before[1:], [False]])[: len(h)]
        salt = np.zeros(len(h), dtype=np.int64)
        salt[order[as_before | as_next]] = 1
        salt *= (mix((uid ^ at).view(np.uint64)) | np.uint64(1)).view(np.int64)
        rows = np.concatenate([np.arange(len(h)), order[as_next & ~as_before]])
        salt = np.concatenate([salt, np.zeros(len(rows) - len(h), dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(uid[rows]), pa.array(at[rows]), pa.array(salt)], names=["h", "uid", "at", "salt"])


def _fragment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal fragments in a stretch of texts only the earliest goes on; a task's rows so grow with its text alone."""
    for b in batches:
        rows: dict[tuple, tuple] = {}
        for uid, ord_, t, found in zip(*[c.to_pylist() for c in b.columns]):
            raw = t.encode()
            h = windows(np.frombuffer(raw, dtype=np.uint8), GRAM).view(np.int64)
            for at in found:
                pos, hi, lo = at >> 14, at >> 7 & 127, at & 127
                key, place = (int(h[pos]), hi, lo, raw[pos - hi : pos - lo + SPAN]), (ord_, uid, pos)
                if key not in rows or place < rows[key]:
                    rows[key] = place
            if len(rows) > 100_000:
                yield _fragments([(*k, *v) for k, v in rows.items()])
                rows = {}
        yield _fragments([(*k, *v) for k, v in rows.items()])


_FRAGMENT = pa.schema([("h", pa.int64()), ("hi", pa.int32()), ("lo", pa.int32()), ("bytes", pa.binary()), ("ord", pa.int64()), ("uid", pa.int64()), ("pos", pa.int64())])


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, _FRAGMENT)], schema=_FRAGMENT)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples, from 0 without gaps."""
    rank = None
    for k in keys:
        one = np.unique(k, return_inverse=True)[1].astype(np.int64)
        rank = one if rank is None else np.unique(rank * (len(k) + 1) + one, return_inverse=True)[1]
    return rank


def repeated_windows(h: np.ndarray, hi: np.ndarray, lo: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """For fragments in order of place: which offsets' windows equal an earlier fragment's. Whole anchors only."""
    n = len(h)
    lines = bytearray(n * WIDTH)
    for i, (p, a) in enumerate(zip(parts, hi)):
        s = i * WIDTH + ANCHOR - int(a)
        lines[s : s + len(p)] = p
    word = np.frombuffer(bytes(lines), dtype="<u8").reshape(n, WIDTH // CELL)
    group = _dense(h)
    last = ANCHOR // CELL  # the sample positions from which 88 bytes are ranked: 1 to last
    one = {q: _dense(word[:, q]) for q in range(1, last + 11)}
    two = {q: _dense(one[q], one[q + 1]) for q in range(1, last + 10)}
    four = {q: _dense(two[q], two[q + 2]) for q in range(1, last + 5)}
    eight = {q: _dense(four[q], four[q + 4]) for q in range(1, last + 1)}
    cover = {q: _dense(group, eight[q], two[q + 8], one[q + 10]) for q in range(1, last + 1)}
    out = np.zeros((n, ROOM + 1), dtype=bool)
    for r in range(ROOM + 1):  # one suffix bucket at a time
        i = np.flatnonzero((lo <= r) & (r <= hi))
        if len(i) < 2:
            continue
        s = ANCHOR - r
        q = -(-s // CELL)
        before = q * CELL - s
        after = SPAN - before - 11 * CELL
        keys = [cover[q][i]]
        if before:
            keys.append(word[i, q - 1] >> np.uint64(8 * (CELL - before)))
        for k, m in ((q + 11, min(after, CELL)), (q + 12, after - CELL)):
            if m > 0:
                keys.append(word[i, k] << np.uint64(8 * (CELL - m)))
        rank = _dense(*keys)
        first = np.full(rank.max() + 1, n)
        np.minimum.at(first, rank, np.arange(len(i)))
        out[i, r] = first[rank] != np.arange(len(i))
    return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; each chunk holds whole anchors."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK and held[0].column(0)[0] != b.column(0)[-1]:
            t = pa.Table.from_batches(held).combine_chunks()
            h = t.column("h").to_numpy()
            n = int(np.searchsorted(h == h[-1], True))  # the last anchor may go on
            yield _settled(t.slice(0, n))
            held = t.slice(n).to_batches()
    if held:
        yield _settled(pa.Table.from_batches(held).combine_chunks())


_SETTLED = pa.schema([("uid", pa.int64()), ("pos", pa.int64()), ("runs", pa.list_(pa.int64()))])


def _settled(t: pa.Table) -> pa.RecordBatch:
    t = t.sort_by([("ord", "ascending"), ("uid", "ascending"), ("pos", "ascending")])
    h, hi, lo, uid, pos = (t.column(c).to_numpy() for c in ("h", "hi", "lo", "uid", "pos"))
    gone = repeated_windows(h, hi, lo, t.column("bytes").to_pylist())
    runs: list[list[int]] = [[] for _ in range(len(h))]
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for (i, a), (_, z) in zip(np.argwhere(edge == 1), np.argwhere(edge == -1)):  # offsets a to z - 1
        runs[i] += [int(pos[i] - z + 1), int(pos[i] - a + SPAN)]
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(pos), pa.array(runs, pa.list_(pa.int64()))], schema=_SETTLED)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone, spans, sha, flat = [], [], [], []
        for t, runs in zip(b.column(1), b.column(2).to_pylist()):
            raw = (t.as_py() or "").encode()
            runs = joined([(x["a"], x["z"]) for x in runs])
            left, at = [], 0
            for a, z in runs:
                left.append(raw[at:a])
                at = z
            gone.append(sum(z - a for a, z in runs))
            spans.append(len(runs))
            sha.append(hashlib.sha256(b"".join([*left, raw[at:]])).hexdigest())
            flat.append([x for r in runs for x in r])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(flat, pa.list_(pa.int64()))], names=["uid", "gone", "spans", "sha", "runs"])


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and runs (flat firsts and ends of removed bytes)."""
    last = F.lit(2**63 - 1)  # where rows without doc_id stand
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", last))
    same = rows.groupBy("doc_id", "ord", "uid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("times"))
    same = cut(same, "dedup-rows")
    first = same.groupBy("uid").agg(F.min("ord").alias("ord"))
    met = rows.select("uid", "text").mapInArrow(_anchor_rows, "h long, uid long, at long, salt long")
    ends = [f"{f}({c}) over (partition by h, salt) as {f}_{c}" for f in ("min", "max") for c in ("uid", "at")]
    met = met.selectExpr("h", "uid", "at", "salt", *ends).filter("salt <> 0 or min_uid <> max_uid or min_at <> max_at")
    met = cut(met.select("h", "uid", "at").distinct(), "dedup-anchors")
    per_text = met.groupBy("uid").agg(F.collect_list("at").alias("found")).join(first, "uid")
    parts = _one_row(rows, per_text).select("uid", "ord", "text", "found").mapInArrow(_fragment_rows, "h long, hi int, lo int, bytes binary, ord long, uid long, pos long")
    place = F.min(F.struct("ord", "uid", "pos")).alias("p")
    parts = parts.repartition("h").groupBy("h", "hi", "lo", "bytes").agg(place).select("h", "hi", "lo", "bytes", "p.ord", "p.uid", "p.pos")
    settled = parts.sortWithinPartitions("h").mapInArrow(_resolve, "uid long, pos long, runs array<long>")
    settled = cut(settled, "dedup-settled")
    pos = F.shiftright("at", 14)
    copies = met.withColumn("pos", pos).join(settled.select("uid", "pos"), ["uid", "pos"], "left_anti").select("uid", (F.col("pos") - F.shiftright("at", 7).bitwiseAND(127)).alias("a"), (F.col("pos") - F.col("at").bitwiseAND(127) + SPAN).alias("z"))
    pairs = F.expr("transform(sequence(1, size(runs) div 2), i -> struct(runs[2 * i - 2] as a, runs[2 * i - 1] as z))")
    found = settled.filter(F.size("runs") > 0).select("uid", F.explode(pairs).alias("x")).select("uid", "x.a", "x.z")
    per_text = copies.unionByName(found).groupBy("uid").agg(F.collect_list(F.struct("a", "z")).alias("found")).join(first, "uid")
    done = _one_row(rows, per_text).select("uid", "text", "found").mapInArrow(_cut_text, "uid long, gone long, spans long, sha string, runs array<long>")
    done = done.withColumnsRenamed({"sha": "kept", "spans": "n"})
    out = same.withColumn("turn", F.explode(F.expr("sequence(1L, times)"))).join(first.withColumnRenamed("ord", "least"), "uid").join(done, "uid", "left")
    leads = (F.col("ord") == F.col("least")) & (F.col("turn") == 1)
    copy = ~leads & (F.col("n_bytes") >= SPAN)
    head = leads & F.col("kept").isNotNull()
    none = F.array().cast("array<long>")
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).when(head, F.col("gone")).otherwise(0).cast("long").alias("n_removed"), F.when(copy, 1).when(head, F.col("n")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(head, F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"), F.when(copy, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).when(head, F.col("runs")).otherwise(none).alias("runs"),
    )


def _one_row(rows: DataFrame, small: DataFrame) -> DataFrame:
    """small (one row a text: uid, ord) with the text, from the text's first row. The join is by doc_id too, so copies
    don't meet, and equal rows are then already beside each other."""
    return rows.select("uid", "ord", "text").join(small, ["uid", "ord"]).dropDuplicates(["uid", "ord"])
