"""Text forms of values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: TCP flag names with their bits, in the order in which they are shown.
TCP_FLAGS = [("SYN", 2), ("FIN", 1), ("RST", 4), ("PSH", 8), ("URG", 32), ("ECE", 64), ("CWR", 128), ("ACK", 16)]


def ipv4(c: Column) -> Column:
    """A number as dotted text."""
    return F.concat_ws(".", *[F.shiftright(c.cast("long"), s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def mac(c: Column) -> Column:
    """The low 48 bits as six pairs."""
    h = F.lower(F.lpad(F.hex(c.cast("long").bitwiseAND((1 << 48) - 1)), 12, "0"))
    return F.concat_ws(":", *[F.substring(h, 1 + 2 * i, 2) for i in range(6)])


def tcp_flags(c: Column) -> Column:
    names = F.array_compact(F.array(*[F.when(c.bitwiseAND(b) > 0, F.lit(n)) for n, b in TCP_FLAGS]))
    return F.when(F.size(names) == 0, "none").otherwise(F.array_join(names, "+"))


def duration(seconds: Column) -> Column:
    """HH:MM:SS; hours may exceed 24, negative spans show as none."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), two(F.floor(s % 3600 / 60)), two(s % 60))


def ipv6(raw: Column) -> Column:
    """Sixteen bytes in the short form of RFC 5952: the first longest run of two or more zero groups as ::, the last four
    bytes of a mapped address as IPv4."""
    h = F.lower(F.hex(raw))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(h.substr(i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    line = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    short = line
    for n in range(8, 1, -1):
        run = ":" + "0:" * n
        shorter = F.concat(F.substring_index(line, run, 1), F.lit("::"), F.regexp_replace(line, f"^.*?{run}", ""))
        short = F.when(F.contains(line, F.lit(run)) & (short == line), shorter).otherwise(short)
    plain = F.regexp_replace(F.regexp_replace(short, "^:([0-9a-f])", "$1"), "([0-9a-f]):$", "$1")
    mapped = F.concat(F.lit("::ffff:"), ipv4(F.conv(h.substr(F.lit(25), F.lit(8)), 16, 10).cast("long")))
    return F.when(F.startswith(h, F.lit("0" * 20 + "ffff")), mapped).otherwise(plain)


def value_bytes(name: str, raw: Column) -> Column:
    """Bytes by their length and the name of their field: MAC, IPv4 and IPv6 addresses, else hexadecimal, 32 bytes at most."""
    h = F.lower(F.hex(raw))
    pairs = F.regexp_replace(F.regexp_replace(h, "(..)", "$1:"), ":$", "")
    out = F.when(F.octet_length(raw) == 6, pairs)
    if name.endswith(("_addr", "_ip", "_address")):
        out = out.when(F.octet_length(raw) == 4, ipv4(F.conv(h, 16, 10).cast("long"))).when(F.octet_length(raw) == 16, ipv6(raw))
    return out.otherwise(F.when(F.octet_length(raw) > 32, F.concat(F.left(h, F.lit(64)), F.lit("…"))).otherwise(h))


def si_bytes(n: Column) -> Column:
    """1.2 MB: one decimal, steps of a thousand; plain bytes below."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("kB", 10**3), ("MB", 10**6), ("GB", 10**9), ("TB", 10**12)):
        out = F.when(n >= size, F.concat(F.format_string("%.1f", n / size), F.lit(f" {unit}"))).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def rfc3339(micros: Column) -> Column:
    """Microseconds since 1970 as UTC text, with a fraction only if there is one."""
    whole = F.date_format(F.timestamp_seconds(F.floor(micros / 1_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros, F.lit(1_000_000))
    return F.concat(whole, F.when(part > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 6, "0"), "0+$", ""))).otherwise(""), F.lit("Z"))


def time_of_day(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "HH:mm:ss.SSS")


#: Names that are not simply in capitals.
NAMES = {"ethernet": "Ethernet", "ipv4": "IPv4", "ipv6": "IPv6", "icmpv4": "ICMPv4", "icmpv6": "ICMPv6", "wireguard": "WireGuard", "l2tpv3": "L2TPv3", "pppoe": "PPPoE", "dhcpv6": "DHCPv6", "mdns": "mDNS", "rocev2": "RoCEv2", "modbus": "Modbus", "radiotap": "Radiotap", "geneve": "Geneve", "syslog": "Syslog"}


def route_name(route: Column) -> Column:
    """The protocol that claims a route with the number, as IPv4 (0x0800) or TLS (443); else the bare number."""
    from .protocols import routes

    claimed = {r: NAMES.get(p.name, p.name.upper()) for r, p in routes().items() if not r.startswith("name:")}
    names = F.create_map(*[F.lit(x) for pair in claimed.items() for x in pair])
    number = F.substring_index(route, ":", -1)
    return F.when(names[route].isNotNull(), F.concat(names[route], F.lit(" ("), number, F.lit(")"))).otherwise(number)


def hex_dump(raw: Column) -> Column:
    """Lines of a four-digit offset and sixteen bytes."""
    h = F.lower(F.hex(raw))
    lines = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length(raw) / 16).cast("int") - 1), lambda i: F.concat(F.lpad(F.lower(F.hex(i * 16)), 4, "0"), F.lit("  "), F.rtrim(F.regexp_replace(h.substr(i * 32 + 1, F.lit(32)), "(..)", "$1 "))))
    return F.when(F.octet_length(raw) > 0, F.array_join(lines, "\n")).otherwise("")


def key_parts(key: Column, most: int = 8) -> Column:
    """The parts of a canonical key, as hexadecimal with their tags: an array, filled by one fold."""

    def step(a: Column, _: Column) -> Column:
        rest = a["rest"]
        tag = F.left(rest, F.lit(2))
        size = F.when(tag.isin("00", "04"), 6 + 2 * F.conv(F.substring(rest, 3, 4), 16, 10).cast("int")).when(tag == "03", 4).otherwise(18)
        more = F.when(F.length(rest) > 0, F.array(F.left(rest, size))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(a["parts"], more).alias("parts"), rest.substr(size + 1, F.length(rest)).alias("rest"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), key.alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["parts"])


def part_struct(name: str, part: Column) -> Column:
    """name, text and num of a key part."""
    tag, body = F.left(part, F.lit(2)), F.substring(part, 3, 1 << 20)
    raw = F.unhex(F.substring(part, 7, 1 << 20))
    number = F.when(tag == "01", F.conv(body, 16, 10).cast("decimal(20,0)")).when(tag == "02", F.conv(body, 16, -10).cast("decimal(20,0)"))
    text = F.when(tag == "04", F.decode(raw, "utf-8")).when(tag == "00", value_bytes(name, raw)).when(tag == "03", F.when(body == "01", "true").otherwise("false")).otherwise(number.cast("string"))
    return F.struct(F.lit(name).alias("name"), text.alias("text"), number.cast("double").alias("num"))


def key_fields(parts: Column, initiator: Column, shared: tuple[str, ...], sides: list[tuple[str, str]]) -> list[Column]:
    """name, text, num of each key field: shared ones, then for each side's parts the source's and the destination's, which
    the initiator tells apart."""
    parts = [F.get(parts, i) for i in range(len(shared) + 2 * len(sides))]
    out = [part_struct(n, p) for n, p in zip(shared, parts)]
    low, high = parts[len(shared) : len(shared) + len(sides)], parts[len(shared) + len(sides) :]
    for (a, b), lo, hi in zip(sides, low, high):
        out += [part_struct(a, F.when(initiator == 0, lo).otherwise(hi)), part_struct(b, F.when(initiator == 0, hi).otherwise(lo))]
    return out


#: What a protocol declares of its key fields: None for a number that is not negative, else how many bytes.
Known = dict[str, int | None]


def known_fields(key: Column, initiator: Column, shared: tuple[str, ...], sides: list[tuple[str, str]], known: Known) -> list[Column]:
    """key_fields where each part's kind and width are known, so that it lies at a fixed place."""
    at, found = 1, []
    for n in (*shared, *(a for a, _ in sides), *(b for _, b in sides)):
        head, size = (2, 16) if known[n] is None else (6, 2 * known[n])
        found.append((at + head, size))
        at += head + size

    def field(name: str, place: Column | int, size: int) -> Column:
        body = key.substr(place if isinstance(place, Column) else F.lit(place), F.lit(size))
        number = F.conv(body, 16, 10)
        if known[name] is None:
            return F.struct(F.lit(name).alias("name"), number.alias("text"), number.cast("double").alias("num"))
        return F.struct(F.lit(name).alias("name"), _bytes_text(name, body, known[name]).alias("text"), F.lit(None).cast("double").alias("num"))

    out = [field(n, *f) for n, f in zip(shared, found)]
    low, high = found[len(shared) : len(shared) + len(sides)], found[len(shared) + len(sides) :]
    for (a, b), (lo, size), (hi, _) in zip(sides, low, high):
        out += [field(a, F.when(initiator == 0, lo).otherwise(hi), size), field(b, F.when(initiator == 0, hi).otherwise(lo), size)]
    return out


def _bytes_text(name: str, h: Column, size: int) -> Column:
    """value_bytes of so many bytes that stand as hexadecimal."""
    if size == 6:
        return F.lower(F.concat_ws(":", *[F.substring(h, 1 + 2 * i, 2) for i in range(6)]))
    if size == 4 and name.endswith(("_addr", "_ip", "_address")):
        return F.concat_ws(".", *[F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10) for i in range(4)])
    return value_bytes(name, F.unhex(h))


def endpoints(fields: list[Column], shared: tuple[str, ...], sides: list[tuple[str, str]]) -> Column:
    """A ↔ B of the pairs, ports with a colon before them; other fields as name=value, without the constant app. fields are
    those of key_fields."""
    names = [*shared, *(n for s in sides for n in s)]
    text = {n: f["text"] for n, f in zip(reversed(names), reversed(fields))}
    shown = lambda n: F.concat(F.lit(":"), text[n]) if n.endswith("port") else text[n]
    paired = [n for s in sides for n in s]
    pair = [F.concat(*[shown(a) for a, _ in sides], F.lit(" ↔ "), *[shown(b) for _, b in sides])] if sides else []
    rest = [F.concat(F.lit(f"{n}="), f["text"]) for n, f in zip(names, fields) if n not in (*paired, "app")]
    return F.array_join(F.array(*pair, *rest), " ") if pair or rest else F.lit("")
