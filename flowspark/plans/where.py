"""The filter language over streams, compiled to a column. `or` binds weakest, then `and` (which may be left out), `not`.

Terms: field op value, a flag (closed, live, open, root, leaf, condensed), a /regex/, or free text; they read the columns of
operators.views.records. A name that is no field is a key field, then a rollup, of the stream. Every comparison holds if any
candidate value does, so a field without candidates holds for no operator, != included. Numbers take k, M, G, T (powers of 1000) and, for
duration, ms, s, m, h. Errors carry the position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<punct>\(|\)|==|!=|=~|!~|>=|<=|>|<|=|&&|\|\||!)|/(?P<regex>(?:\\.|[^/\\])+)/|\"(?P<quoted>[^\"]*)\"|(?P<word>[^\s()=!<>&|\"]+))")
_SCALE = {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12}
_TIME = {"ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_NUMBERS = {"id": "id", "packets": "packets", "pkts": "packets", "bytes": "bytes", "opaque": "opaque_bytes", "depth": "depth", "children": "n_children"}
_DURATION = ("duration", "dur")
_TEXTS = {"proto": "proto", "protocol": "proto", "state": "state", "reason": "reason", "close_reason": "reason", "endpoint": "endpoint", "ep": "endpoint", "host": "endpoint", "addr": "endpoint", "port": "port", "parent": "parent", "under": "under", "ancestor": "under", "in": "under"}
_FLAGS = {"closed": lambda: F.col("closed").isNotNull(), "live": lambda: F.col("closed").isNull(), "open": lambda: F.col("closed").isNull(), "root": lambda: F.col("depth") == 0, "leaf": lambda: F.col("n_children") == 0, "condensed": lambda: F.contains(F.col("path"), F.lit(":FE"))}
PATTERN = 1 << 20  # fixed value: the longest regular expression
_OPS = {"==", "=", "is", "!=", "=~", "!~", ">", ">=", "<", "<=", "contains", "has"}


class QueryError(ValueError):
    def __init__(self, what: str, at: int):
        super().__init__(f"{what} at column {at + 1}")
        self.at = at


@dataclass
class Where:
    column: Column

    def filter(self, nodes: DataFrame) -> DataFrame:
        return nodes.filter(self.column)


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("unexpected character", at + len(text[at:]) - len(text[at:].lstrip()))
        kind = m.lastgroup
        out.append((kind, m[kind], m.start(kind)))
        at = m.end()
    return out


def _shown() -> Column:
    """What free text searches: protocol, number, endpoints and state of a stream."""
    return F.concat_ws(" ", "protocol", F.concat(F.lit("#"), F.col("id")), "endpoints", "state")


def _candidates(name: str) -> Column:
    """Candidate values of a field: an array of text and number."""
    text = lambda c: F.struct(c.cast("string").alias("text"), F.lit(None).cast("double").alias("num"))
    number = lambda c: F.struct(c.cast("string").alias("text"), c.cast("double").alias("num"))
    plain = lambda fields: F.transform(fields, lambda f: F.struct(f["text"].alias("text"), f["num"].alias("num")))
    known = _TEXTS.get(name)
    if name in _NUMBERS:
        return F.array(number(F.col(_NUMBERS[name])))
    if name in _DURATION:
        return F.array(number(F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(0)) / F.col("second")))
    if known in ("proto", "state", "reason"):
        return F.array(text(F.coalesce(F.col({"proto": "protocol", "state": "state", "reason": "closed"}[known]), F.lit(""))))
    if known == "endpoint":
        return F.transform(F.split("endpoints", " ↔ | "), text)
    if known == "port":
        return F.transform("ports", lambda p: F.struct(p.cast("long").cast("string").alias("text"), p.alias("num")))
    if known == "parent":
        return F.array(text(F.coalesce(F.try_element_at("ancestors.protocol", F.lit(-1)), F.lit(""))))
    if known == "under":
        return F.transform("ancestors", lambda a: text(a["protocol"]))
    own = lambda c: plain(F.filter(c, lambda f: f["name"] == name))
    return F.concat(own("key_fields"), own("rollups"))


def _number(text: str, time: bool) -> float | None:
    m = re.fullmatch(r"(-?\d+(?:\.\d+)?)([A-Za-z]*)", text)
    if not m:
        return None
    scale = 1.0 if not m[2] else (_TIME | {} if time else _SCALE).get(m[2].lower())
    return None if scale is None else float(m[1]) * scale


def _regex(body: str, at: int) -> str:
    if len(body) > PATTERN:
        raise QueryError("the regular expression is too long", at)
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", body):
        raise QueryError("look-around and back-references are not supported", at)
    try:
        re.compile(body)
    except re.error as e:
        raise QueryError(f"bad regex: {e}", at) from None
    return "(?i)" + body.replace("\\/", "/")


class _Parser:
    def __init__(self, text: str):
        self.all, self.i, self.end = _tokens(text), 0, len(text)
        if self.all and self.all[0][1].lower() == "where":
            self.i = 1

    def peek(self) -> tuple[str, str, int]:
        return self.all[self.i] if self.i < len(self.all) else ("end", "", self.end)

    def take(self) -> tuple[str, str, int]:
        t = self.peek()
        self.i += 1
        return t

    def either(self) -> Column:
        out = self.both()
        while self.peek()[0] in ("word", "punct") and self.peek()[1].lower() in ("or", "||"):
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.unary()
        while True:
            kind, value, _ = self.peek()
            if kind in ("word", "punct") and value.lower() in ("and", "&&"):
                self.take()
            elif kind == "end" or value in (")", "||") or kind == "word" and value.lower() == "or":
                return out
            out = out & self.unary()

    def unary(self) -> Column:
        kind, value, _ = self.peek()
        if kind in ("word", "punct") and value.lower() in ("not", "!"):
            self.take()
            return ~self.unary()
        return self.primary()

    def primary(self) -> Column:
        kind, value, at = self.take()
        if value == "(" and kind == "punct":
            out = self.either()
            if self.take()[1] != ")":
                raise QueryError("missing )", self.all[min(self.i, len(self.all)) - 1][2])
            return out
        if kind == "regex":
            return _shown().rlike(_regex(value, at))
        if kind == "end" or kind == "punct":
            raise QueryError("a term is missing", at)
        if kind == "word" and self.peek()[0] in ("word", "punct") and self.peek()[1].lower() in _OPS:
            return self.compare(value.lower(), at)
        if kind == "word" and value.lower() in _FLAGS:
            return _FLAGS[value.lower()]()
        return F.contains(F.lower(_shown()), F.lit(value.lower()))

    def compare(self, name: str, at: int) -> Column:
        """True if any candidate value compares so; a field without candidates holds for no operator, != included."""
        op = self.take()[1].lower()
        kind, value, where = self.take()
        if kind in ("end", "punct"):
            raise QueryError("a value is missing", where)
        if kind == "regex":
            op = "!~" if op in ("!=", "!~") else "=~"
        candidates = _candidates(name)
        if op in ("=~", "!~"):
            pattern = _regex(value, where)
            return F.exists(candidates, lambda c: c["text"].rlike(pattern) if op == "=~" else ~c["text"].rlike(pattern))
        if op in ("contains", "has"):
            return F.exists(candidates, lambda c: F.contains(F.lower(c["text"]), F.lit(value.lower())))
        number = _number(value, name in _DURATION)
        if op in (">", ">=", "<", "<="):
            if _number(value, False) is None and _number(value, True) is None:
                raise QueryError("a number is needed", where)
            if number is None:
                return F.lit(False)
            test = {">": lambda c: c > number, ">=": lambda c: c >= number, "<": lambda c: c < number, "<=": lambda c: c <= number}[op]
            return F.exists(candidates, lambda c: F.coalesce(test(c["num"]), F.lit(False)))
        same = lambda c: F.lower(c["text"]) == value.lower()
        equal = same if number is None else lambda c: F.when(c["num"].isNotNull(), c["num"] == number).otherwise(same(c))
        return F.exists(candidates, lambda c: ~equal(c) if op == "!=" else equal(c))


def compile_where(text: str) -> Where:
    p = _Parser(text)
    if p.peek()[0] == "end":
        return Where(F.lit(True))
    out = p.either()
    if p.peek()[0] != "end":
        raise QueryError("unexpected )", p.peek()[2])
    return Where(out)
