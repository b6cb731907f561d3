"""IP address tests on text columns, without any Python in the tasks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = "[0-9a-f]{1,4}"
# Eight groups, or fewer around one `::`.
_COLONS = "|".join(
    [rf"{_GROUP}(?::{_GROUP}){{7}}", rf"::(?:{_GROUP}(?::{_GROUP}){{0,6}})?"]
    + [rf"{_GROUP}(?::{_GROUP}){{{n}}}::(?:{_GROUP}(?::{_GROUP}){{0,{5 - n}}})?" for n in range(6)]
    + [rf"{_GROUP}(?::{_GROUP}){{6}}::"]
)

# IPv4 blocks that have no place on a map.
_IPV4_SPECIAL = [
    "0.0.0.0/32",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "255.255.255.255/32",
]
# The same for IPv6 — unspecified and loopback, unique local, link local, multicast, documentation.
_IPV6_SPECIAL = [
    r"[0:]*:0{0,3}[01]?",
    r"[0:]*:0\.0\.0\.[01]",
    r"f[cd][0-9a-f]{2}:.*",
    r"fe[89ab][0-9a-f]:.*",
    r"ff[0-9a-f]{2}:.*",
    r"2001:0?db8:.*",
]


def block_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a block, as numbers."""
    address, bits = cidr.split("/")
    low = reduce(lambda total, octet: total * 256 + int(octet), address.split("."), 0)
    return low, low + (1 << (32 - int(bits))) - 1


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null when it is not dotted-quad text."""
    part = lambda n: F.split_part(ip, F.lit("."), F.lit(n)).cast("long")
    return F.when(ip.rlike(rf"\A{_DOTTED}\z"), ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


#: What stands before the 32 bits of an IPv4 address in its 128-bit form.
_MAPPED = "0" * 20 + "f" * 4


def number_key(number: Column) -> Column:
    """The 128-bit form, as 32 hex digits, of an IPv4 address given as a number."""
    return F.concat(F.lit(_MAPPED), F.lower(F.lpad(F.hex(number.cast("long")), 8, "0")))


def address_key(ip: Column) -> Column:
    """An address of either family as 32 hex digits, which sort as the address does; null for other text."""
    text = F.lower(ip)
    dotted = F.regexp_extract(text, rf":({_DOTTED})\z", 1)
    low = F.lower(F.lpad(F.hex(ipv4_number(dotted)), 8, "0"))
    plain = F.when(dotted == "", text).otherwise(
        F.concat(F.regexp_replace(text, rf"{_DOTTED}\z", ""), F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4))
    )
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    sides = F.split(plain, "::")
    head, tail = groups(sides[0]), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0)))
    wide = F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), "")
    v6 = F.when(plain.rlike(rf"\A(?:{_COLONS})\z"), wide)
    return F.when(ip.contains(":"), v6).otherwise(number_key(ipv4_number(ip)))


def key_bucket(key: Column) -> Column:
    """A number for the leading bits of a key: 16 of an IPv4 address, 24 of an IPv6 one; neighbours have neighbouring numbers."""
    first = lambda start, digits: F.conv(F.substring(key, start, digits), 16, 10).cast("long")
    return F.when(key.startswith(_MAPPED), first(25, 4)).otherwise(F.lit(1 << 32) + first(1, 6))


def is_public_ip(ip: Column) -> Column:
    """Whether an address may be looked up for a country."""
    special = lambda n: reduce(or_, [n.between(*block_bounds(c)) for c in _IPV4_SPECIAL])
    public_v4 = ~F.exists(F.array(ipv4_number(ip)), special)
    text = F.lower(ip)
    # A dotted tail stands for two groups.
    valid_v6 = F.regexp_replace(text, rf":{_DOTTED}\z", ":0:0").rlike(rf"\A(?:{_COLONS})\z")
    public_v6 = valid_v6 & ~text.rlike(rf"\A(?:{'|'.join(_IPV6_SPECIAL)})\z")
    return F.coalesce(F.when(ip.contains(":"), public_v6).otherwise(public_v4), F.lit(False))
