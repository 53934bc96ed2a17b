"""Addresses and address ranges as fixed-width numbers, compared by Catalyst alone.

An address is (family, hi, lo): an IPv4 address is 32 bits of ``lo``, an IPv6 address 128 bits in
two longs. A range is an address and a length; an address lies in it if both have the same first
``length`` bits, its prefix. So a test against many ranges is one hash lookup for each length
that occurs among them, and a join with a table of ranges is an equi-join on prefixes.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import any_of

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_GROUP = r"^[0-9a-f]{1,4}$"


def _v4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    total = F.lit(0).cast("long")
    for i in range(4):
        total = total * 256 + parts[i].cast("long")
    return total


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _half(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, at, 16), 16, -10).cast("long")


def _six(halves: Column) -> Column:
    """(6, hi, lo) of the texts left and right of ``::``, or of one text without it."""
    none = F.array().cast("array<string>")
    some = lambda half: F.when(F.coalesce(half, F.lit("")) == "", none).otherwise(F.split(half, ":"))
    sides = F.struct(some(halves[0]).alias("left"), some(F.get(halves, F.lit(1))).alias("right"), F.size(halves).alias("halves"))

    def whole(s: Column) -> Column:
        given = F.size(s["left"]) + F.size(s["right"])
        sound = F.forall(F.concat(s["left"], s["right"]), lambda g: g.rlike(_GROUP)) & F.when(s["halves"] == 1, given == 8).otherwise((s["halves"] == 2) & (given <= 7))
        groups = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), s["right"])
        digits = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(sound, _let(digits, lambda d: F.struct(F.lit(6).alias("family"), _half(d, 1).alias("hi"), _half(d, 17).alias("lo"))))

    return _let(sides, whole)


def address(text: Column) -> Column:
    """(family, hi, lo) of an IPv4 or IPv6 address in text form; null for anything else, zones and bracketed forms included.

    An IPv6 address may be shortened by one ``::`` and end in IPv4 form. Addresses that embed an IPv4 address stay IPv6.
    """
    said = lambda n: F.lower(F.hex(n))

    def plain(low: Column) -> Column:
        """An IPv4 ending as two hexadecimal groups."""
        tail = F.regexp_extract(low, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        return _let(tail, lambda t: F.when(t.rlike(_V4), _let(_v4(t), lambda n: F.concat(F.regexp_replace(low, r"\d+\.\d+\.\d+\.\d+$", ""), said(F.shiftright(n, 16)), F.lit(":"), said(n.bitwiseAND(0xFFFF))))).otherwise(low))

    def parsed(low: Column) -> Column:
        four = F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), _v4(low).alias("lo"))
        return F.when(low.rlike(_V4), four).when(low.contains(":"), _six(F.split(plain(low), "::")))

    return _let(F.lower(F.trim(text)), parsed)


def prefix(addr: Column, length: Column) -> Column:
    """The first ``length`` bits of an address, as a value that is equal for equal prefixes of one family and length; null beyond the family's bits.

    Shifts take a number of places below 64, so lengths that leave nothing of a half are told apart.
    """
    length = length.cast("int")
    four = F.when(length == 0, F.lit(0)).otherwise(_shift(addr["lo"], F.lit(32) - length))
    hi = F.when(length == 0, F.lit(0)).when(length >= 64, addr["hi"]).otherwise(_shift(addr["hi"], F.lit(64) - length))
    lo = F.when(length <= 64, F.lit(0)).when(length == 128, addr["lo"]).otherwise(_shift(addr["lo"], F.lit(128) - length))
    fits = (length >= 0) & (length <= F.when(addr["family"] == 4, 32).otherwise(128))
    return F.when(fits, F.struct(addr["family"].alias("family"), length.alias("length"), F.when(addr["family"] == 4, F.lit(0)).otherwise(hi).cast("long").alias("hi"), F.when(addr["family"] == 4, four).otherwise(lo).cast("long").alias("lo")))


def _shift(value: Column, places: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, F.pmod(places, F.lit(64)).cast("int"))


def parse_range(text: str) -> tuple[int, int, int, int]:
    """(family, length, hi, lo) of a range's prefix; a lone address is a range of its own. ValueError for anything else; bits beyond the length don't count."""
    net = ipaddress.ip_network(text.strip(), strict=False)
    bits = int(net.network_address) >> (net.max_prefixlen - net.prefixlen)
    if net.version == 4:
        return 4, net.prefixlen, 0, bits
    sign = lambda n: n - (1 << 64) if n >> 63 else n
    if net.prefixlen <= 64:
        return 6, net.prefixlen, sign(bits), 0
    rest = net.prefixlen - 64
    return 6, net.prefixlen, sign(bits >> rest), sign(bits & ((1 << rest) - 1))


def in_ranges(text: Column, ranges: list[str]) -> Column:
    """Whether an address in text form lies in one of some ranges (ValueError for a bad one): a hash lookup for each length that occurs. No address lies in none."""
    by: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for r in ranges:
        family, length, hi, lo = parse_range(r)
        by.setdefault((family, length), set()).add((hi, lo))

    def test(addr: Column) -> Column:
        return any_of([_held(addr, family, length, sorted(some)) for (family, length), some in sorted(by.items())])

    return F.coalesce(_let(address(text), test), F.lit(False))


def _held(addr: Column, family: int, length: int, some: list[tuple[int, int]]) -> Column:
    """Whether an address's first bits are one of some (hi, lo)."""
    p = prefix(addr, F.lit(length))
    if family == 4 or length <= 64:
        own = p["lo"].isin([lo for _, lo in some]) if family == 4 else p["hi"].isin([hi for hi, _ in some])
    else:
        own = F.concat_ws(":", p["hi"].cast("string"), p["lo"].cast("string")).isin([f"{hi}:{lo}" for hi, lo in some])
    return (addr["family"] == family) & own


def range_table(ranges: DataFrame, column: str = "cidr") -> DataFrame:
    """``ranges`` with ``prefix``, by JVM functions alone; ranges that can't be read are left out."""
    text = F.trim(F.col(column))
    given = F.regexp_extract(text, "/(\\d{1,3})$", 1)

    def own(addr: Column) -> Column:
        length = F.when(~text.contains("/"), F.when(addr["family"] == 4, 32).otherwise(128)).when(given != "", given.cast("int"))
        return prefix(addr, length)

    return ranges.withColumn("prefix", _let(address(F.substring_index(text, "/", 1)), own)).where(F.col("prefix").isNotNull())


def longest_match(rows: DataFrame, column: str, ranges: DataFrame, keep: list[str]) -> DataFrame:
    """``rows`` with the columns ``keep`` of the longest range that holds their address, and ``prefix_length``; rows outside all ranges are left out, of equal ranges the first by ``keep`` counts.

    ``ranges`` comes from range_table(). Each distinct address is looked up once, by an equi-join on its prefix of every length that occurs among the ranges
    (161 at most); the rows then meet their address, so a frequent address costs no more than a rare one.
    """
    known = ranges.groupBy("prefix").agg(F.min(F.struct(*keep)).alias("told"))
    lengths = ranges.groupBy(F.col("prefix.family").alias("family")).agg(F.array_sort(F.collect_set("prefix.length")).alias("lengths"))  # two rows
    each = rows.select(F.col(column).alias("address__")).where(F.col("address__").isNotNull()).distinct().withColumn("addr", address(F.col("address__"))).where(F.col("addr").isNotNull())
    asked = each.join(F.broadcast(lengths), F.col("addr.family") == F.col("family")).select("address__", "addr", F.explode("lengths").alias("length"))
    met = asked.select("address__", prefix(F.col("addr"), F.col("length")).alias("prefix")).join(known, "prefix")
    best = met.groupBy("address__").agg(F.max_by(F.struct("told", F.col("prefix.length").alias("length")), F.col("prefix.length")).alias("best"))
    return rows.join(best, rows[column] == best["address__"]).select(rows["*"], *[F.col(f"best.told.{k}").alias(k) for k in keep], F.col("best.length").alias("prefix_length"))
