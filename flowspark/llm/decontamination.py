"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. The automaton holds every run of words
of every item; a document's words stream through it, and after each word the state and the matched length say which
windows (min_words consecutive item words, or a whole shorter item) end there. Time is in proportion to the words.

The items are a stated set: they come to the driver and go out in blocks of at most BLOCK_WORDS words, one automaton
(at most twice as many states) at a time; each further block is a further pass over the rows of the pass before.

Nulls: a null text has no words; a null item text has no window, a null item_id counts as the empty string. Items of
equal item_id count once. Repeated rows each get a row. Empty tables on either side give no hits. Extra columns are
ignored by match_items and kept by remove_contamination.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

BLOCK_WORDS = 100_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of many word sequences. Of each state: transitions, suffix link and longest length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for item, words in items:
            at = 0
            for w in words:
                at = self._extend(at, w)
        owners: list[set[str]] = [set() for _ in self.next]
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            at = 0
            for w in words:
                at = self.next[at][w]
                up = at
                while up > 0 and item not in owners[up]:
                    owners[up].add(item)
                    up = self.link[up]
            if 0 < len(words) < window:
                ends.append((at, len(words), item))
        for at, n, item in ends:
            self.short.setdefault(at, []).append((n, item))
        # base: for a state of length window or more, the one that holds its suffix of window words
        self.items, self.shorts = [None] * len(self.next), [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= window:
                self.items[v] = self.items[up] if self.length[up] >= window else frozenset(owners[v])
            self.shorts[v] = (*self.shorts[up], *self.short.get(v, ()))

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Runs of hit words as [first, end), the items whose windows occur, and the longest matched length."""
        nxt, link, length, window, shorts = self.next, self.link, self.length, self.window, self.shorts
        v = matched = longest = 0
        here, root = nxt[0], nxt[0]
        runs: list[list[int]] = []
        found: set[str] = set()
        for i, w in enumerate(words):
            t = here.get(w)
            if t is None:
                if not v:
                    continue
                v = link[v]
                while v and w not in nxt[v]:
                    v = link[v]
                matched = length[v]
                t = nxt[v].get(w)
                if t is None:
                    here = root
                    continue
            v, here = t, nxt[t]
            matched += 1
            if matched > longest:
                longest = matched
            hit = 0
            if matched >= window:
                hit = window
                found |= self.items[v]
            for n, item in shorts[v]:
                if n <= matched:
                    hit = max(hit, n)
                    found.add(item)
            if hit:
                first = i + 1 - hit
                while runs and runs[-1][0] >= first:  # a shorter window inside the new one
                    runs.pop()
                if runs and runs[-1][1] >= first:
                    runs[-1][1] = i + 1
                else:
                    runs.append([first, i + 1])
        return runs, found, longest


def item_blocks(items: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> list[list[tuple[str, list[bytes]]]]:
    """The items' words in blocks; a longer item is cut into pieces that share window - 1 words, so no window is lost."""
    blocks, n = [[]], 0
    for item, text in pick(items, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        words = words_of((text or "").encode())
        step = max(1, block_words - window + 1)
        for a in range(0, max(1, len(words) - window + 1), step):
            piece = words[a : a + step + window - 1] if len(words) >= window else words
            if n and n + len(piece) > block_words:
                blocks, n = [*blocks, []], 0
            if piece:
                blocks[-1].append((item, piece))
                n += len(piece)
    return blocks


_built: dict[str, Automaton] = {}


def _automaton(shared, window: int) -> Automaton:
    """One is kept for each worker."""
    key = f"{shared.value[0]}:{window}"
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(shared.value[1], window)
    return _built[key]


def _joined(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan_items(docs: DataFrame, items: DataFrame, window: int = 8, block_words: int = BLOCK_WORDS, after: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """docs with __n (words), __runs (flat firsts and ends of hit words), __items and __longest added; or what `after` makes
    of such batches, of docs' own columns: in the same worker, so that no second one holds the texts."""
    sc = docs.sparkSession.sparkContext
    names = docs.columns
    text = names.index("text")
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = docs.selectExpr("*", "0L as __n", "cast(array() as array<int>) as __runs", "cast(array() as array<string>) as __items", "0 as __longest")
    own = out.select(*docs.columns).schema
    blocks = item_blocks(items, window, block_words)
    for k, block in enumerate(blocks):
        finish = after if k == len(blocks) - 1 else None
        digest = hashlib.sha256(repr(block).encode()).hexdigest()
        shared = sc.broadcast((digest, block))  # at most block_words words

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, k=k, finish=finish) -> Iterator[pa.RecordBatch]:
            sam = _automaton(shared, window)
            for b in batches:
                n, runs, found, longest = [], [], [], []
                old = [b.column(len(names) + j) for j in range(4)]
                for i, t in enumerate(b.column(text)):
                    words = words_of(t.as_py().encode()) if t.is_valid else []
                    r, f, m = sam.scan(words)
                    if k:
                        before = old[1][i].as_py()
                        r = _joined([*r, *map(list, zip(before[::2], before[1::2]))])
                        f = f | set(old[2][i].as_py())
                        m = max(m, old[3][i].as_py())
                    n.append(len(words))
                    runs.append([x for y in r for x in y])
                    found.append(sorted(f))
                    longest.append(m)
                new = [pa.array(x, c.type) for x, c in zip((n, runs, found, longest), old)]
                done = pa.RecordBatch.from_arrays([*b.columns[: len(names)], *new], schema=b.schema)
                yield finish(done) if finish else done

        out = out.mapInArrow(scan, own if finish else out.schema)
    return out.toDF(*names, *[] if after else ("__n", "__runs", "__items", "__longest"))


_HIT = "cast(aggregate(sequence(0, size(__runs) div 2), 0, (a, i) -> a + coalesce(get(__runs, 2 * i + 1) - get(__runs, 2 * i), 0)) as long)"


def match_items(docs: DataFrame, items: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) and longest (the longest run of words that is an item's)."""
    out = scan_items(pick(docs, "doc_id", "text"), items, window)
    return out.selectExpr("doc_id", "__n as n_words", f"{_HIT} as n_hit", "__items as items", "__longest as longest")


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 8, max_coverage: float = 0.5) -> DataFrame:
    """docs without the spans of hit words; a document of which more than max_coverage is hit goes as a whole."""
    names = docs.columns
    text = names.index("text")

    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, texts = [], []
        for i, (t, n, r) in enumerate(zip(b.column(text), b.column(len(names)), b.column(len(names) + 1))):
            t, r = t.as_py(), r.as_py()
            if sum(r[1::2]) - sum(r[::2]) > max_coverage * n.as_py():
                continue
            if r:
                raw = t.encode()
                ends = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
                kept, at = [], 0
                for a, z in zip(r[::2], r[1::2]):
                    kept.append(raw[at : ends[a][0]])
                    at = ends[z - 1][1]
                t = b"".join([*kept, raw[at:]]).decode()
            keep.append(i)
            texts.append(t)
        cols = [c.take(pa.array(keep, pa.int64())) for c in b.columns[: len(names)]]
        cols[text] = pa.array(texts, b.column(text).type)
        return pa.RecordBatch.from_arrays(cols, names=b.schema.names[: len(names)])

    return scan_items(docs, items, window, after=clean)
