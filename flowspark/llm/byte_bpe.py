"""Byte-level BPE encoding and decoding with recursive queries in DuckDB, inside each Spark partition.

A text is cut into pieces by the tokenizer's pattern. A worker keeps what it has encoded, and gives new distinct pieces
to its own DuckDB, where a row is a token at a position of a piece: a recursive query joins neighbours with the merge
table and contracts each piece's leftmost pair of least rank until none is left; an ordered aggregation gives the ids
and, joined with the vocabulary, the bytes that they decode to. A piece that is a token enters as that one token. A
text's ids and bytes are those that its pieces' aggregations gave, joined.

The recursion keeps the rows of every round, so a chunk holds pieces with a sum of squared lengths of at most CHUNK. A
piece of more than LONG bytes has a query of its own, which runs some rounds, gives its tokens and goes on from them; a
round contracts all its pairs of the least rank, from the left where they overlap, which gives the same as one by one
unless the vocabulary has a lesser rank for a pair with the new token: then only the leftmost. A worker keeps about two
generations of KEEP pieces and forgets those that the later did not use; results do not depend on it.

The vocabulary file is a parameter and is read by each worker from its own installation.

Nulls: a null text is empty and has no ids. Repeated rows each get a row. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

CHUNK = 1_000_000
LONG = 1000
KEEP = 200_000

_ENCODE = """
with recursive tokens(round, w, pos, id) as (
    select 0, w, pos, id from first_rows
    union all
    (
        with least as (
            select a.w, min((m.id << 24) | a.pos) as k
            from tokens a join tokens z on z.w = a.w and z.pos = a.pos + 1 join merges m on m.l = a.id and m.r = z.id
            group by a.w
        )
        select t.round + 1, t.w, if(t.pos > (k & 16777215), t.pos - 1, t.pos), if(t.pos = (k & 16777215), k >> 24, t.id)
        from tokens t join least using (w)
        where t.pos <> (k & 16777215) + 1
    )
),
ends as (select w, max(round) as round from tokens group by w)
select w, string_agg(t.id::varchar, ' ' order by pos) as ids, unhex(string_agg(v.hex, '' order by pos)) as decoded
from tokens t join ends using (w, round) join vocabulary v on v.id = t.id
group by w
"""
_ROUNDS = """
with recursive tokens(round, pos, after, id) as (
    select 0, pos, after, id from first_rows
    union all
    (
        with pairs as (
            select a.pos, z.pos as gone, z.after, a.after - a.pos as width, m.id, m.early
            from tokens a join tokens z on z.pos = a.after join merges m on m.l = a.id and m.r = z.id
        ),
        least as (select *, pos - width * row_number() over (order by pos) as run from pairs where id = (select min(id) from pairs)),
        hit as materialized (select pos, gone, after, id from least qualify row_number() over (partition by run order by pos) % 2 = 1 and (not early or pos = min(pos) over ()))
        select t.round + 1, t.pos, coalesce(h.after, t.after), coalesce(h.id, t.id)
        from tokens t left join hit h on h.pos = t.pos left join hit g on g.gone = t.pos
        where g.gone is null and t.round < {rounds} and exists (select 1 from hit)
    )
)
select round, pos, after, id from tokens where round = (select max(round) from tokens) order by pos
"""
_ENDS = """
select string_agg(t.id::varchar, ' ' order by pos) as ids, unhex(string_agg(v.hex, '' order by pos)) as decoded
from first_rows t join vocabulary v on v.id = t.id
"""


class Encoder:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        early = {x for l, r, m in merges for x in (l, r) if m < x}  # a token that a lesser rank may take up at once
        # What a chunk holds is bounded, so nothing is spilled to the executor's disk.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        l, r, m = map(list, zip(*merges))
        pairs = pa.table({"l": pa.array(l, pa.int64()), "r": pa.array(r, pa.int64()), "id": pa.array(m, pa.int64()), "early": [x in early for x in m]})
        words = pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "hex": [t.hex() for t in self.ranks]})
        self.db.register("pair_rows", pairs)
        self.db.register("word_rows", words)
        self.db.execute("create table merges as from pair_rows; create table vocabulary as from word_rows")
        self.db.unregister("pair_rows")
        self.db.unregister("word_rows")
        self.kept: dict[str, tuple[str, bytes]] = {}  # a piece's ids as text, and the bytes that they decode to
        self.older: dict[str, tuple[str, bytes]] = {}  # the generation before; what is used again moves up

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces, in chunks."""
        chunk, cost = [], 0
        for p in pieces:
            raw = p.encode()
            if len(raw) > LONG and raw not in self.ranks:
                self.kept[p] = self._long(raw)
                continue
            chunk.append((p, raw))
            cost += len(raw) ** 2
            if cost > CHUNK:
                self._query(chunk)
                chunk, cost = [], 0
        if chunk:
            self._query(chunk)

    def _query(self, chunk: list[tuple[str, bytes]]) -> None:
        whole = [self.ranks.get(raw) for _, raw in chunk]
        n = np.array([len(raw) if r is None else 1 for (_, raw), r in zip(chunk, whole)])
        first = np.cumsum(n) - n
        ids = self.single[np.frombuffer(b"".join(raw if r is None else b"\0" for (_, raw), r in zip(chunk, whole)), dtype=np.uint8)]
        ids[first[[r is not None for r in whole]]] = [r for r in whole if r is not None]
        self.db.register("first_rows", pa.table({"w": np.repeat(np.arange(len(n)), n), "pos": np.arange(n.sum()) - np.repeat(first, n), "id": ids}))
        for w, ids, decoded in self.db.execute(_ENCODE).fetchall():
            self.kept[chunk[w][0]] = ids, decoded
        self.db.unregister("first_rows")

    def _long(self, raw: bytes) -> tuple[str, bytes]:
        at = np.arange(len(raw))
        rows = pa.table({"pos": at, "after": at + 1, "id": self.single[np.frombuffer(raw, dtype=np.uint8)]})
        while True:
            rounds = max(8, CHUNK // len(rows))
            self.db.register("first_rows", rows)
            rows = self.db.sql(_ROUNDS.format(rounds=rounds)).to_arrow_table()
            self.db.unregister("first_rows")
            if rows.column("round")[0].as_py() < rounds:
                break
        self.db.register("first_rows", rows)
        found = self.db.execute(_ENDS).fetchall()[0]
        self.db.unregister("first_rows")
        return found

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; all of them are in kept afterwards."""
        found = [self.split(t) for t in texts]
        if len(self.kept) > KEEP:
            self.kept, self.older = {}, self.kept
        new = []
        for p in set(itertools.chain.from_iterable(found)).difference(self.kept):
            if p in self.older:
                self.kept[p] = self.older[p]
            else:
                new.append(p)
        self.learn(new)
        return found


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _batches(texts: pa.Array, most: int = 500_000) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    yield group


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (as text, joined by one space), decoded (bytes); with ids=False their SHA-256 instead."""
    docs = pick(docs, "doc_id", "text")
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids"), (F.lit(b"") if ids else F.lit("")).alias("decoded")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            n, out, raw = [], [], []
            for texts in _batches(b.column(1)):
                for found in own.pieces(texts):
                    got = [own.kept[p] for p in found]
                    line = " ".join([x for x, _ in got])
                    whole = b"".join([x for _, x in got])
                    n.append(line.count(" ") + 1 if line else 0)
                    out.append(line if ids else hashlib.sha256(line.encode()).hexdigest())
                    raw.append(whole if ids else hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, pa.string()), pa.array(raw, pa.binary() if ids else pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(work, schema)
