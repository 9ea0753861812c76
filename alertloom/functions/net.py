"""IP addresses and networks as column expressions.

IPv4 addresses become BIGINT, IPv6 addresses a 32-digit lower-case hex string;
in both forms a network is a closed range, so membership is a comparison and
needs no Python worker.
"""

from __future__ import annotations

import ipaddress
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom import fixed_values as fixed
from alertloom.functions.bind import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def ipv4_number(address: Column) -> Column:
    """Dotted quad as BIGINT; NULL for anything else, leading zeros included."""
    octets = F.split(address, r"\.")
    number = reduce(
        lambda total, i: total * 256 + octets[i].cast("bigint"), range(1, 4), octets[0].cast("bigint")
    )
    return F.when(address.rlike(rf"^{_DOTTED_QUAD}\z"), number)


def _groups(part: Column) -> Column:
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))


def ipv6_hex(address: Column) -> Column:
    """IPv6 text as 32 hex digits; NULL if it is not one. A ``%scope`` is dropped."""
    readable = F.contains(address, F.lit(":")) & address.rlike(r"^[0-9A-Fa-f:.]+(?:%[^%]+)?\z")
    bare = F.lower(F.split(address, "%")[0])
    return F.when(readable, let(_without_dotted_tail(bare), _hex_of_groups))


def _without_dotted_tail(bare: Column) -> Column:
    """Write a trailing dotted quad as two hex groups."""
    tail = F.substring_index(bare, ":", -1)
    quad = F.lower(F.lpad(F.hex(ipv4_number(tail)), 8, "0"))
    head = F.substr(bare, F.lit(1), F.length(bare) - F.length(tail))
    spelled = F.concat(head, F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4))
    return F.when(F.contains(tail, F.lit(".")), spelled).otherwise(bare)


def _hex_of_groups(plain: Column) -> Column:
    halves = F.split(plain, "::", -1)
    sides = F.transform(halves, _groups)
    return F.when(F.size(halves) <= 2, let(sides, _join_sides))


def _join_sides(sides: Column) -> Column:
    known = F.aggregate(sides, F.lit(0), lambda n, side: n + F.size(side))
    well_formed = F.forall(F.flatten(sides), lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
    whole = (F.size(sides) == 1) & (known == 8)
    compressed = (F.size(sides) == 2) & (known <= 7)
    texts = F.transform(sides, lambda side: F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), ""))
    zeros = F.repeat(F.lit("0000"), 8 - known)
    digits = F.when(whole, texts[0]).otherwise(F.concat(texts[0], zeros, F.get(texts, F.lit(1))))
    return F.when(well_formed & (whole | compressed), digits)


def _ipv4_in(number: Column, networks: Iterable[str]) -> Column:
    """Membership in a fixed list: one set lookup per prefix length in use."""
    by_length: dict[int, set[int]] = defaultdict(set)
    for text in networks:
        network = ipaddress.ip_network(text, strict=False)
        if network.version == 4:
            by_length[network.prefixlen].add(int(network.network_address) >> (32 - network.prefixlen))
    tests = [
        F.shiftright(number, 32 - length).isin(sorted(heads)) for length, heads in sorted(by_length.items())
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _ipv6_in(digits: Column, networks: Iterable[str]) -> Column:
    ranges = [
        (f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}")
        for n in (ipaddress.ip_network(t, strict=False) for t in networks)
        if n.version == 6
    ]
    return reduce(lambda a, b: a | b, [digits.between(lo, hi) for lo, hi in ranges], F.lit(False))


def _ipv4_private(number: Column) -> Column:
    return _ipv4_in(number, fixed.IPV4_PRIVATE) & ~_ipv4_in(number, fixed.IPV4_GLOBAL_EXCEPTIONS)


def is_global(address: Column, own_network: str | None = None) -> Column:
    """True for a globally reachable address outside ``own_network``; never NULL.

    The own network is compared with IPv4 addresses only.  An IPv4-mapped IPv6
    address is judged by its IPv4 part; text that is no address is not global.
    """
    number = ipv4_number(address)
    outside = lambda n: ~_ipv4_in(n, [own_network] if own_network else [])
    answer = F.when(F.contains(address, F.lit(":")), let(ipv6_hex(address), _ipv6_global)).otherwise(
        let(number, lambda n: outside(n) & ~_ipv4_private(n) & ~_ipv4_in(n, [fixed.IPV4_SHARED]))
    )
    return F.coalesce(answer, F.lit(False))


def _ipv6_global(digits: Column) -> Column:
    mapped = F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")
    special = _ipv6_in(digits, fixed.IPV6_NOT_GLOBAL) & ~_ipv6_in(digits, fixed.IPV6_GLOBAL_EXCEPTIONS)
    return F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), ~let(mapped, _ipv4_private)).otherwise(~special)


def valid_networks(networks: Iterable[str]) -> tuple[list[str], bool]:
    """The networks before the first unreadable one, and whether there was one."""
    readable: list[str] = []
    for text in networks:
        try:
            ipaddress.ip_network(text, strict=False)
        except ValueError:
            return readable, True
        readable.append(text)
    return readable, False


def in_networks(address: Column, networks: Iterable[str]) -> Column:
    """Membership of an address in a list of IPv4 and IPv6 networks; never NULL."""
    networks = list(networks)
    answer = F.when(
        F.contains(address, F.lit(":")), let(ipv6_hex(address), lambda d: _ipv6_in(d, networks))
    ).otherwise(let(ipv4_number(address), lambda n: _ipv4_in(n, networks)))
    return F.coalesce(answer, F.lit(False))
