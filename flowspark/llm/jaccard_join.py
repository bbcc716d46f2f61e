"""Exact Jaccard self-join on word shingles by universe partitioning.

Sizes fall into bands. A band's scheme hashes the shingles of a set into segments. Two sets that are similar enough
differ in at most H shingles, so with segments that allow d_i - 1 differences each and sum(d_i) > H, some segment of
theirs holds to its allowance: the pair meets in the signature of that segment's subset (d = 1) or of the subset or its
one-deletion neighbourhood (d = 2). A cost model splits H + 1 + slack units over segments: few wide segments with
neighbourhoods for small sets, many plain ones for large sets. The slack pays for leaving out (d = 0) empty segments,
which too many sets share; a set with more of them than the slack emits them all, so no pair is lost.
A set uses its own band's scheme and those of the lower bands whose sets it can match.

Equal sets are one class. Each class is first verified against one leader, of the least classes of its signatures the
one that it shares most with. After that only classes of a signature that are in different components still need
comparing, so a large group of near copies never becomes all its pairs. Sizes and parity sketches bound the difference
from below inside that join, and a pair comes out of the least signature that it shares, so that few rows come out;
those are verified on whole sets.

Each pair carries a whole set to the other, and rows that meet are wide, so both go in waves: what is on the disks at a
time grows with the corpus, however many pairs or meetings it holds.

Shingles, sets and signatures stand as 64-bit hashes: 1e9 different ones hold a false match with a chance of 3 %.
Nulls: a null text is empty; empty texts link with nothing. A null doc_id takes part like any row, and a component's
id is the least doc_id that is not null. Repeated rows each get a row. Empty tables give empty results. Extra columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_last, discard, numbered, pick, position, row_key, sieved
from .hashing import chunks, lower, mix, shingle_sets

BAND = 1.3
SMALL = 0  # shingles of a segment that too many sets share
SKETCH = 8  # longs of 64 parity bits, at least
LEADERS, ROUNDS = (4, 32, 32), 3
LOW = 16  # signatures by which a pair knows that it met before
#: What one wave may carry, as a share of the corpus' shingles: sets to compare, and rows of about 40 longs that meet.
CARRY, WIDE = 0.25, 0.02
#: The cost model: chance that related but different sets agree on a shingle, and the weight of a chance meeting. Measured
#: on 47,000 sets: leaving out segments of up to three shingles, or a weight of 200, took three to four times the
#: signatures and two to nine times the meetings, since slack and neighbourhoods make more and smaller segments.
AGREE, MEETING = 0.35, 50.0


class Scheme:
    """Segments of the band of sizes lo to hi - 1, for a similarity of at least percent / 100."""

    def __init__(self, band: int, lo: int, hi: int, percent: int):
        self.band = band
        self.reach = (hi - 1) * 100 // percent  # the largest set that a set of the band can match
        units = (hi - 1 + self.reach) * (100 - percent) // (100 + percent) + 1
        best = min(sorted({units // 2 * k // 32 for k in range(33)}), key=lambda a: self._cost(lo, units - a, a))
        small = self._few(lo / (units - best)) * (units - best)
        self.slack = 0 if units - best < 4 else int(np.ceil(1.2 * small + 2 * np.sqrt(small)))
        self.segments, self.wide = units - best + self.slack, best
        self.tag = mix(np.arange(self.segments, dtype=np.uint64) + np.uint64((band + 1) << 32))

    @staticmethod
    def _few(mean: float) -> float:
        """Chance that a segment holds at most SMALL shingles, of `mean` expected."""
        term, total = np.exp(-mean), 0.0
        for k in range(SMALL + 1):
            total += term
            term *= mean / (k + 1)
        return float(total)

    @staticmethod
    def _cost(lo: int, segments: int, wide: int) -> float:
        held = lo / segments
        plain = 1 + MEETING * AGREE**held
        return (segments - wide) * plain + wide * (plain + held * (1 + MEETING * AGREE ** max(held - 1, 0)))

    def signatures(self, tokens: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of n sets, and the set of each; of says which set each token belongs to."""
        segment = (mix(tokens ^ np.uint64(0xA5A5 + self.band)) % np.uint64(self.segments)).astype(np.int64)
        at = of * self.segments + segment
        value = mix(tokens + np.uint64(1))
        total = np.zeros(n * self.segments, dtype=np.uint64)
        np.add.at(total, at, value)
        few = (np.bincount(at, minlength=len(total)) <= SMALL).reshape(n, self.segments)
        few[:, : self.wide] = False
        few[few.sum(axis=1) > self.slack] = False
        keep = np.flatnonzero(~few.ravel())
        out, whose = mix(total[keep] ^ self.tag[keep % self.segments]), keep // self.segments
        if self.wide:
            near = np.flatnonzero(segment < self.wide)
            out = np.concatenate([out, mix((total[at[near]] - value[near]) ^ self.tag[segment[near]])])
            whose = np.concatenate([whose, of[near]])
        return out, whose


def _lows() -> list[int]:
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


LOWS = _lows()


@functools.lru_cache(maxsize=64)
def scheme(band: int, percent: int) -> Scheme:
    return Scheme(band, LOWS[band], LOWS[band + 1], percent)


def all_signatures(tokens: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of the sets that begin at `at` in tokens (one end more), and the set of each."""
    n = np.diff(at)
    band, sigs, whose = np.searchsorted(LOWS, n, "right") - 1, [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    reach = np.array([(x - 1) * 100 // percent for x in LOWS[1:]])
    while len(left := np.flatnonzero((band >= 0) & (n > 0) & (reach[band] >= n))):
        for b in np.unique(band[left]):
            own = left[band[left] == b]
            these = np.concatenate([tokens[at[i] : at[i + 1]] for i in own])
            out, of = scheme(int(b), percent).signatures(these, np.repeat(np.arange(len(own)), n[own]), len(own))
            sigs.append(out)
            whose.append(own[of])
        band = band - 1
    return np.concatenate(sigs), np.concatenate(whose)


def class_key(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens) - 2**63


def sketches(tokens: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Parity bits of each set, a power of two of them and at least 0.4 for each shingle; halves xor to the sketch of half
    the size. An empty set has none."""
    n = np.diff(at)
    longs = np.full(len(n), SKETCH)
    while (more := longs * 64 < 0.4 * n).any():
        longs[more] *= 2
    begin = np.concatenate([[0], np.cumsum(longs)])
    place = np.repeat(begin[:-1], n) * 64 + (mix(tokens ^ np.uint64(77)) % np.repeat(longs * 64, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=64 * begin[-1]) & 1
    bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(bits), mask=pa.array(n == 0))


def _keys(tokens: np.ndarray, at: np.ndarray) -> list[int | None]:
    return [class_key(tokens[i:j]) if j > i else None for i, j in zip(at[:-1], at[1:])]


def _describe(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for raw, begin in chunks(b.column(2)):
                tokens, at = shingle_sets(lower(raw), begin, size)
                own = b.slice(done, len(begin) - 1)
                done += len(own)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.diff(at), pa.int64()), pa.array(_keys(tokens, at), pa.int64()), sketches(tokens, at)], names=["doc_id", "row", "n", "key", "bits"])

    return work


def _emit(size: int, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this partition
        for b in batches:
            for raw, begin in chunks(b.column(0)):
                tokens, at = shingle_sets(lower(raw), begin, size)
                keys, new = _keys(tokens, at), []
                for i, k in enumerate(keys):
                    if k is not None and k not in seen:
                        seen.add(k)
                        new.append(i)
                n = np.diff(at)[new]
                fresh = np.concatenate([tokens[:0], *[tokens[at[i] : at[i + 1]] for i in new]])
                sigs, whose = all_signatures(fresh, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), percent)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(np.array([keys[i] for i in new], dtype=np.int64)[whose])], names=["sig", "key"])

    return work


def _whole(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for raw, begin in chunks(b.column(1)):
                tokens, at = shingle_sets(lower(raw), begin, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(begin) - 1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.view(np.int64)))], names=["key", "tokens"])
                done += len(begin) - 1

    return work


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (key, comp) after joining what the edges (a, b) link: each component hooks onto its least neighbour and
    pointers are halved, until no edge runs between components. Only tables, nothing on the driver but counts."""
    between = edges.join(labels.withColumnsRenamed({"key": "a", "comp": "x"}), "a").join(labels.withColumnsRenamed({"key": "b", "comp": "y"}), "b").filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    between = cut(between, "cc-edges")
    steps = []
    while not between.isEmpty():
        hook = between.groupBy("y").agg(F.min("x").alias("x"))  # y > x, so hooks make no circle
        hook = cut(hook, "cc-hook")
        while True:
            jumped = hook.alias("h").join(hook.alias("g"), F.col("h.x") == F.col("g.y"), "left").select("h.y", F.coalesce("g.x", "h.x").alias("x"), F.col("g.x").isNotNull().alias("moved"))
            jumped = cut(jumped, "cc-jump")
            hook = jumped.select("y", "x")
            if jumped.filter("moved").isEmpty():
                break
        steps.append(hook)
        to = lambda df, c: df.join(hook.select(F.col("y").alias(c), F.col("x").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        between = cut(to(to(between, "x"), "y").filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "cc-edges")
    for hook in steps:
        labels = labels.join(hook.select(F.col("y").alias("comp"), F.col("x").alias("__to")), "comp", "left").select("key", F.coalesce("__to", "comp").alias("comp"))
    return cut(labels, "cc-labels") if steps else labels


def similar_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, n and key of each document, and the components (key, comp) of the classes that met another."""
    rows = pick(docs, "doc_id", "text").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    shape = rows.select("doc_id", "row", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("array<long>").alias("bits")).schema
    described = cut(rows.mapInArrow(_describe(size), shape), "jaccard-docs")
    shingles = described.agg(F.sum("n")).first()[0] or 0
    classes = described.filter("key is not null").groupBy("key").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    sigs = rows.select("text").mapInArrow(_emit(size, percent), "sig long, key long")
    met = sigs.selectExpr("sig", "key", "min(key) over (partition by sig) as leader", "max(key) over (partition by sig) as last").filter("leader <> last").select("sig", "key", "leader").distinct()
    met = cut(met, "jaccard-met")
    labels = cut(met.select("key").distinct().withColumn("comp", F.col("key")), "jaccard-labels")
    # First each class with the leaders that share most signatures with it, then with other leaders of signatures whose
    # classes are still apart, while that links any; at last all that is apart.
    mixed, known, tokens = met.withColumns({"comp": F.col("key"), "other": F.col("leader")}), None, None
    for turn in range(ROUNDS):
        stars = mixed.filter("comp <> other").groupBy(F.col("leader").alias("a"), F.col("key").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        stars = stars.withColumn("place", F.expr("row_number() over (partition by b order by shared desc, a)")).filter(f"place <= {LEADERS[turn]}").select("a", "b")
        stars = cut(_possible(stars if known is None else stars.join(known, ["a", "b"], "left_anti"), classes, percent), "jaccard-stars")
        known = stars.select("a", "b") if known is None else known.unionByName(stars.select("a", "b"))
        wanted = stars.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        new = _tokens(rows, classes, wanted if tokens is None else wanted.join(tokens.select("key"), "key", "left_anti"), size)
        tokens = cut(new, "jaccard-tokens") if tokens is None else tokens.unionByName(cut(new, "jaccard-tokens"))
        links = _similar(stars, tokens, percent, CARRY * shingles)
        labels = components(labels, links)
        there = mixed.select("sig", "key").join(labels, "key")
        mixed = there.selectExpr("*", "min(comp) over (partition by sig) as c0", "max(comp) over (partition by sig) as c1", f"min(struct(xxhash64(key, {turn}) as x, key, comp)) over (partition by sig) as lead")
        mixed = cut(mixed.filter("c0 <> c1").select("sig", "key", "comp", F.col("lead.key").alias("leader"), F.col("lead.comp").alias("other")), "jaccard-mixed")
        if links.isEmpty():
            break
    low = mixed.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LOW).alias("low"))  # a class's signatures are bounded by its own set
    packed = classes.select("key", "n", "bits", *[_folded(i).alias(f"w{i}") for i in range(SKETCH)]).withColumn("bits", F.when(F.size("bits") > SKETCH, F.col("bits")))
    waves, found = _waves(mixed.count(), WIDE * shingles), []
    apart = (F.col("key_a") < F.col("key_b")) & (F.col("comp_a") != F.col("comp_b")) & _near(percent) & _first_meeting()
    low = cut(low, "jaccard-low")
    for w in range(waves):
        wide = cut(mixed.filter(_wave("sig", waves) == w).select("sig", "key", "comp").join(packed, "key").join(low, "key"), "jaccard-wide")
        side = lambda x: wide.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in wide.columns if c != "sig"])  # noqa: B023, E731
        pairs = side("a").join(side("b").withColumnRenamed("sig", "sig_b"), (F.col("sig") == F.col("sig_b")) & apart).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.col("n_b").alias("n")).distinct()
        found.append(cut(pairs.join(known, ["a", "b"], "left_anti"), "jaccard-left"))
        discard(wide)
    left = _union(found).distinct() if waves > 1 else found[0]
    if not left.isEmpty():
        more = left.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(tokens.select("key"), "key", "left_anti")
        tokens = tokens.unionByName(cut(_tokens(rows, classes, more, size), "jaccard-tokens"))
        labels = components(labels, _similar(left, tokens, percent, CARRY * shingles))
    return described, labels


def _folded(i: int) -> Column:
    """Long i of the sketch folded to SKETCH longs."""
    return F.aggregate(F.sequence(F.lit(i), F.size("bits") - 1, F.lit(SKETCH)), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get("bits", k)))


def _near(percent: int) -> Column:
    """_allowed, with the folded sketch as plain columns first: compiled code settles most pairs."""
    differ = sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(1, SKETCH)), F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    folded = differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return sizes & folded & (F.col("bits_a").isNull() | F.col("bits_b").isNull() | _allowed(percent))


def _first_meeting() -> Column:
    """False where the pair surely meets in a lesser signature too. The least LOW signatures of both sides decide: if
    they share any, they hold the least that the pair shares, so each pair keeps a meeting and mostly only one."""
    return F.coalesce(F.array_min(F.array_intersect("low_a", "low_b")), F.col("sig")) >= F.col("sig")


def _allowed(percent: int) -> Column:
    """What sizes and parity sketches allow: differing bits are differing shingles, at least."""
    m = F.least(F.size("bits_a"), F.size("bits_b"))
    fold = lambda x: F.when(F.size(x) == m, F.col(x)).otherwise(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.get(x, i).bitwiseXOR(F.get(x, i + m))))
    differ = F.aggregate(F.zip_with(fold("bits_a"), fold("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return F.when(sizes, differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).otherwise(False)


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    side = lambda c: classes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_allowed(percent)).select("a", "b", F.col("n_b").alias("n"))


def _tokens(rows: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """key and the whole set of each wanted class, from the text of one row of the class."""
    of = cut(classes.select("key", "row").join(wanted, "key"), "jaccard-wanted")
    texts = sieved(rows.select("row", "text"), "row", of).join(of, "row").dropDuplicates(["key"]).select("key", "text")
    return texts.mapInArrow(_whole(size), "key long, tokens array<long>")


def _waves(carried: int, most: float) -> int:
    return max(1, -int(-carried // max(1, most)))


def _wave(column: str, waves: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit("wave")), F.lit(waves))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _similar(pairs: DataFrame, tokens: DataFrame, percent: int, most: float) -> DataFrame:
    """The pairs whose sets are similar, by exact counts. A pair (a, b, n) carries b's n shingles to a; a wave has the
    pairs of some b, which carry about `most` shingles."""
    waves, found = _waves(pairs.agg(F.sum("n")).first()[0] or 0, most), []
    for w in range(waves):
        own, sets = (pairs, tokens) if waves == 1 else (pairs.filter(_wave("b", waves) == w), tokens.filter(_wave("key", waves) == w))
        side = lambda c, t: t.select(F.col("key").alias(c), F.col("tokens").alias(f"t_{c}"))
        out = own.select("a", "b").join(side("b", sets), "b").join(side("a", tokens), "a").withColumn("both", F.size(F.array_intersect("t_a", "t_b")))
        found.append(cut(out.filter((F.size("t_a") + F.size("t_b") - F.col("both")) * percent <= F.col("both") * 100).select("a", "b"), "jaccard-links"))
    return _union(found)


def row_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles and comp, the component's own key (null without shingles): one row for each row of docs."""

    def work() -> DataFrame:
        described, labels = similar_classes(docs, size, percent)
        own = described.select("doc_id", "row", F.col("n").alias("n_shingles"), "key").join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        return own.select("doc_id", "row", "n_shingles", "comp")

    return cut_last(work, "jaccard-own")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row, n_shingles, component_id: one row for each row of docs."""
    own = row_components(docs, size, percent)
    least = own.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return own.join(least, "comp", "left").select("doc_id", "row", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the least by doc_id (nulls last), then by row key. Empty texts all stay.
    Components go by their own key, so null or repeated doc_ids bring no unlinked texts together."""
    found = row_components(docs, size, percent)
    empty = F.col("n_shingles") == 0
    best = found.filter(~empty).groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    keep = cut(best.select("row").unionByName(found.filter(empty).select("row")).distinct(), "jaccard-keep")
    rows = numbered(docs)
    doc_id, text = (F.col(f"c{position(docs, n)}") for n in ("doc_id", "text"))
    rows = rows.withColumn("row", row_key(doc_id, text)).join(keep, "row", "left_semi")
    # equal rows share a row key: one of them stays, unless empty
    blank = F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), F.lit("")) == ""
    place = F.row_number().over(Window.partitionBy("row").orderBy(doc_id))
    return rows.withColumns({"blank": blank, "place": place}).filter("blank or place = 1").drop("row", "blank", "place").toDF(*docs.columns)
