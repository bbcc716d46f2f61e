"""Secret scans with linking of multipart credentials (DataFrame functions only).

Base: three kinds of spans by pattern. Weak parts (identifiers, unnamed secrets, named secrets below the base limit,
endpoints) count only where complementary parts lie in one scope: an interval join, within a document, of identifiers and
secrets at most `scope` code points apart; endpoints within the scope of such a pair come with it. A short named secret
counts next to an endpoint alone, too, and the endpoint with it, which may hold it (a password in a query string). An
unnamed secret has a digit: runs of 20 letters are words and paths. The join runs on cells of `scope` code points, so a
part meets only its neighbours and the work stays in proportion to the text, whatever one document holds.

A span's offsets are code points, end exclusive, of the whole match. Nulls: a null text is empty. Equal rows (same
doc_id and text) are scanned once for each and joined by their key; each row gets a result. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, pick, position, row_key

#: Patterns, and the least length of group 2 (assign) or of the match.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
WEAK = {
    "identifier": (r"""(?i)(user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    "secret": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    "endpoint": (r"(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?)", 0, 7),
}
SCANNED = [*BASE, *WEAK]
KINDS = [*SCANNED, "named"]  # named: what assign finds below its limit
SCOPE = 200


def _found(t: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (before, match, counted): the lengths of the text before each match since the last, of the match, and
    of what the limit holds for. Split and extract find the same matches in the same order."""
    if (pattern, group) == (BASE["hex"][0], 0):
        pattern = r"[0-9a-f]{16,}"  # a run is taken whole, so the limit can stand in the pattern
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(t, pattern).alias("b"), whole.alias("m"), F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("g"))
    return F.when(t.rlike(pattern), F.transform(zipped, lambda x: F.struct(F.length(x["b"]).alias("before"), F.length(x["m"]).alias("match"), F.length(x["g"]).alias("counted"), x["m"].rlike("[0-9]").alias("digit"))))


def scan(docs: DataFrame) -> DataFrame:
    """key, doc_id and the lengths around the matches of each kind; nothing of the text. Written once."""
    t = F.col("t")
    df = pick(docs, "doc_id", "text").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("t"))
    df = df.select("key", "doc_id", "t", *[_found(t, *BASE[k]).alias(k) for k in BASE], _found(t, *WEAK["identifier"]).alias("identifier"))
    linked = F.col("identifier").isNotNull() | F.col("access").isNotNull()  # without an identifier unnamed secrets don't link
    named = F.exists("assign", lambda x: x["counted"] < BASE["assign"][2])
    ends = F.when(linked | F.coalesce(named, F.lit(False)), _found(t, *WEAK["endpoint"]))
    df = df.select("key", "doc_id", *BASE, "identifier", F.when(linked, _found(t, *WEAK["secret"])).alias("secret"), ends.alias("endpoint"))
    return cut(df, "secret-scan")


def parts(scanned: DataFrame) -> DataFrame:
    """key, kind (its number), start, end: what meets the limits, once for equal rows."""
    some = scanned.filter(F.coalesce(*SCANNED).isNotNull()).dropDuplicates(["key"])
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("x")) for i, k in enumerate(SCANNED)])
    rows = some.select("key", F.explode(each).alias("e")).select("key", "e.kind", F.posexplode("e.x").alias("n", "x"))
    rows = rows.withColumn("end", F.expr("sum(x.before + coalesce(x.match, 0)) over (partition by key, kind order by n)")).filter("x.match is not null")
    short = (F.col("kind") == KINDS.index("assign")) & (F.col("x.counted") < BASE["assign"][2])
    rows = rows.withColumn("kind", F.when(short, F.lit(KINDS.index("named"))).otherwise(F.col("kind")))
    limits = [*[(BASE | WEAK)[k][2] for k in SCANNED], 1]
    least = F.create_map(*[F.lit(v) for x in enumerate(limits) for v in x])[F.col("kind")]
    mixed = (F.col("kind") != KINDS.index("secret")) | F.col("x.digit")
    return rows.filter((F.col("x.counted") >= least) & mixed).select("key", "kind", (F.col("end") - F.col("x.match")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def linked_spans(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The base spans, and the weak parts that a complement within scope confirms."""
    kind = {k: i for i, k in enumerate(KINDS)}
    base = found.filter(F.col("kind") < len(BASE))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    near = lambda a, b: (F.col(f"{a}.start") <= F.col(f"{b}.end") + scope) & (F.col(f"{b}.start") <= F.col(f"{a}.end") + scope)
    named = found.filter(F.col("kind").isin(kind["access"], kind["identifier"])).withColumn("cell", F.explode(F.array(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))).alias("i")
    hidden = found.filter(F.col("kind").isin(kind["assign"], kind["hex"], kind["secret"], kind["named"])).withColumn("cell", cells(F.col("start") - scope, F.col("end") + scope)).alias("s")
    pairs = named.join(hidden, (F.col("i.key") == F.col("s.key")) & (F.col("i.cell") == F.col("s.cell")) & near("i", "s") & ((F.col("i.end") <= F.col("s.start")) | (F.col("s.end") <= F.col("i.start"))))
    pairs = pairs.select(F.col("i.key").alias("key"), *[F.struct(f"{x}.kind", f"{x}.start", f"{x}.end").alias(x) for x in "is"]).distinct()
    both = pairs.select("key", F.explode(F.array("i", "s")).alias("p")).select("key", "p.kind", "p.start", "p.end").distinct()
    ends = found.filter(F.col("kind") == kind["endpoint"]).withColumn("cell", cells(F.col("start") - scope, F.col("end") + scope)).alias("e")
    meets = both.unionByName(found.filter(F.col("kind") == kind["named"]).select(*both.columns)).distinct()  # what endpoints complete
    hosts = ends.join(meets.withColumn("cell", F.explode(F.array(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))).alias("b"), (F.col("e.key") == F.col("b.key")) & (F.col("e.cell") == F.col("b.cell")) & near("e", "b"))
    hosts = hosts.select(F.col("e.key").alias("key"), *[F.struct(f"{x}.kind", f"{x}.start", f"{x}.end").alias(x) for x in "eb"]).distinct()
    hosts = hosts.select("key", F.explode(F.array("e", "b")).alias("p")).select("key", "p.kind", "p.start", "p.end")
    weak = both.unionByName(hosts).filter(F.col("kind") >= len(BASE)).distinct()
    covered = weak.alias("w").join(base.alias("b"), (F.col("w.key") == F.col("b.key")) & (F.col("w.start") < F.col("b.end")) & (F.col("b.start") < F.col("w.end")), "left_anti")
    return base.unionByName(covered)  # a weak part inside a base span adds nothing


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row for each row of docs: key, doc_id and spans, an array of (start, kind, end) in order."""
    scanned = scan(docs)
    spans = linked_spans(cut(parts(scanned), "secret-parts"), scope)
    per_key = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.select("key", "doc_id").join(per_key, "key", "left").withColumn("spans", F.coalesce("spans", none))


def mask_secrets(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by mask. Other texts stay as they are."""
    one = find_secrets(docs, scope).filter(F.size("spans") > 0).dropDuplicates(["key"]).select("key", "spans")
    doc_id, text = (F.col(f"c{position(docs, n)}") for n in ("doc_id", "text"))
    out = numbered(docs).withColumn("key", row_key(doc_id, text)).join(one, "key", "left")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("end"))

    def step(a, x):
        gap = F.when(x["start"] >= a["end"], F.concat(a["s"], text.substr(a["end"] + 1, x["start"] - a["end"]), F.lit(mask))).otherwise(a["s"])
        return F.struct(gap.alias("s"), F.greatest(a["end"], x["end"]).alias("end"))

    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["s"], text.substr(a["end"] + 1, F.length(text))))
    masked = F.when(F.col("spans").isNull(), text).otherwise(clean)
    return out.withColumn(f"c{position(docs, 'text')}", masked).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
