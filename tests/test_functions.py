"""Column functions against the standard library."""

from __future__ import annotations

import ipaddress
import json
import random

from pyspark.sql import functions as F

from alertloom.functions import json_text, net
from alertloom.operators import exposition, requests


def _addresses():
    rng = random.Random(11)
    fixed = [
        "8.8.8.8", "192.168.1.1", "invalid_ip", "2001:db8::1", "fe80::1", "::ffff:8.8.8.8", "::ffff:100.64.0.1", "08.8.8.8",
        "8.8.8.8 ", "8.8.8.8\n", "::", "::1", "1::", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0",
        "fe80::1%", "a::b%c%d", ":::", "1:::2", "1::2::3", "12345::", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:", "2607:F8B0::A",
        "224.0.0.1", "192.0.0.9", "192.0.0.8", "", "1.2.3", "1.2.3.4.5", "::ffff:1.2.3.04", "::1.2.3.4:5", "é::1", "1.2.3.4::",
    ]
    parts = [0, 10, 100, 127, 169, 172, 192, 198, 203, 240, 255, 8]
    for _ in range(1500):
        if rng.random() < 0.5:
            fixed.append(".".join(str(rng.choice([*parts, rng.randint(0, 300)])) for _ in range(4)))
        else:
            groups = [f"{rng.choice([0, 0x2001, 0xDB8, 0xFE80, 0xFC00, 0x2002, 0x64, 0xFF9B, 1, 3, 4, 0x112, rng.randint(0, 70000)]):x}" for _ in range(rng.randint(1, 8))]
            cut = rng.randint(0, len(groups))
            fixed.append(rng.choice([":".join(groups), ":".join(groups[:cut]) + "::" + ":".join(groups[cut:])]))
    return fixed


def test_addresses_agree_with_ipaddress(spark):
    networks = ["10.0.0.0/8", "192.168.1.7/24", "2001:db8::/32", "1.2.3.4", "fe80::/10"]

    def parsed(text):
        try:
            return ipaddress.ip_address(text)
        except ValueError:
            return None

    def expected(text):
        a = parsed(text)
        own = a is not None and a.version == 4 and a in ipaddress.ip_network("8.0.0.0/8")
        inside = a is not None and any(a in ipaddress.ip_network(n, strict=False) for n in networks)
        return bool(a and a.is_global), bool(a and not own and a.is_global), inside

    texts = _addresses()
    c = F.col("a")
    df = spark.createDataFrame([(t,) for t in texts], "a string").select(
        "a", net.is_global(c).alias("g"), net.is_global(c, "8.0.0.0/8").alias("o"), net.in_networks(c, networks).alias("n")
    )
    assert [r for r in df.collect() if (r.g, r.o, r.n) != expected(r.a)] == []


def test_allowlist_rules(spark):
    df = spark.createDataFrame([("10.1.1.1",), ("9.9.9.9",), ("bad",)], "a string")

    def allowed(networks):
        return [r[0] for r in df.select(requests.is_allowed(F.col("a"), networks)).collect()]

    assert allowed([]) == [True] * 3 and allowed(["127.0.0.1", "::1"]) == [True] * 3
    assert allowed(["10.0.0.0/8"]) == [True, False, False]
    assert allowed(["10.0.0.0/8", "nonsense", "9.0.0.0/8"]) == [True, False, False]


def test_network_table_is_the_list(spark):
    readable = ["10.0.0.0/9", "192.168.4.9/255.255.254.0", "172.16.0.0/0.0.15.255", "9.9.9.9", "2001:db8::/33", "fe80::1:0/113", "::1"]
    unreadable = ["1.0.0.0/abc", "2.0.0.0/255.0.255.0", "3.0.0.0/33", "4.0.0.0/8/8", "5.0.0.0/", "2002::/129", "2003::/255.0.0.0", "6.0.0.0/ 8", "x", ""]
    addresses = [
        "10.127.1.1", "10.128.0.0", "192.168.5.1", "192.168.6.0", "172.16.15.255", "172.16.16.0", "9.9.9.9", "9.9.9.8", "2001:db8:7fff::1",
        "2001:db8:8000::", "fe80::1:7fff", "fe80::1:8000", "::1", "::2", "1.0.0.0", "2.0.0.0", "3.0.0.0", "4.0.0.0", "5.0.0.0", "6.0.0.0", "2002::", "2003::", "bad", "", None,
    ]
    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    networks = spark.createDataFrame([(n,) for n in [*readable, *unreadable, None]], "network string")
    listed = {r[0]: r[1] for r in df.select("a", requests.is_allowed(F.col("a"), [*readable, *unreadable])).collect()}
    assert {r.a: r.allowed for r in requests.allowed_by_table(df, networks, "a").collect()} == listed
    assert sum(listed.values()) == 7
    every = spark.createDataFrame([("0.0.0.0/0",), ("::/0",)], "network string")
    assert sum(r.allowed for r in requests.allowed_by_table(df, every, "a").collect()) == len(addresses) - 3


def test_client_address(spark):
    rows = [("1.1.1.1 , 2", "x", "p"), ("", " r ", "p"), (None, "", "p"), (None, None, ""), (" ,x", "r", "p")]
    df = spark.createDataFrame(rows, "f string, r string, p string")
    got = [r[0] for r in df.select(requests.client_address(F.col("f"), F.col("r"), F.col("p"))).collect()]
    assert got == ["1.1.1.1", "r", "p", "127.0.0.1", ""]


def test_quoted_is_json_dumps(spark):
    texts = ["", "abc", 'a"b\\c', "é", "€\U0001f600x", "\x01\x1f\n\t\r\b\f\x7f", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(json_text.quoted(F.col("t"))).collect()] == [json.dumps(t) for t in texts]


def test_number_text_is_the_shortest(spark):
    rng = random.Random(5)
    values = [0.0, 1.0, -2.5, 100.0, 1e15, 1e16, 1.5e16, 123456789.125, 1e7, 12345678.9, 1e-3, 1e-4, 9.9e-5, 1e-5, 3.14e-7, 1e22, -1e-9]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(exposition.number_text(F.col("v"))).collect()]
    assert [g for g, v in zip(got, values) if float(g) != v or len(g) != len(repr(v))] == []
    assert got[:17] == [repr(v) for v in values[:17]]


def test_interval_map_is_the_list_of_networks(spark, monkeypatch):
    """100,000 networks, nested and repeated, as disjoint intervals: by broadcast arrays and by the merge along addresses."""
    rng = random.Random(4)
    texts = [f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.choices([20, 24, 28, 29, 30, 31, 32], [1, 9, 200, 200, 200, 200, 200])[0]}" for _ in range(99_000)]
    texts += [f"2001:db8:{rng.randrange(9)}:{rng.randrange(65536):x}::{rng.randrange(99):x}/{rng.choice([44, 61, 64, 66, 126, 127, 128])}" for _ in range(990)]
    texts += ["192.168.0.0/255.255.0.0", "172.16.5.5/0.0.0.255", "0.0.0.1", "::/127", "ffff::/17", "no", "10.0.0.0/40", "1.2.3.4/5/6", None, ""]
    readable = [ipaddress.ip_network(t, strict=False) for t in texts if t and t not in ("no", "10.0.0.0/40", "1.2.3.4/5/6")]
    asked = [f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(1500)]
    asked += [f"2001:db8:{rng.randrange(10)}:{rng.randrange(65536):x}::{rng.randrange(3)}" for _ in range(200)]
    for n in rng.sample(readable, 200):
        asked += [str(a) for a in (n.network_address, n.broadcast_address, n.network_address - 1 if int(n.network_address) else n.network_address, n.broadcast_address + 1)]
    asked += ["::", "::2", "ffff:7fff:ffff::", "ffff:8000::", "0.0.0.1", "x", "", None, "255.255.255.255"]

    heads: dict[tuple, set[int]] = {}
    for n in readable:
        heads.setdefault((n.version, n.prefixlen, n.max_prefixlen), set()).add(int(n.network_address) >> (n.max_prefixlen - n.prefixlen))

    def inside(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return False
        return any(v == a.version and int(a) >> (most - length) in found for (v, length, most), found in heads.items())

    networks = spark.createDataFrame([(t,) for t in texts], "network string").repartition(4)
    frame = spark.createDataFrame([(a,) for a in asked], "a string")
    spans = sorted((r._lo, r._hi) for r in requests.interval_map(networks).collect())
    assert all(lo <= hi < next_lo for (lo, hi), (next_lo, _) in zip(spans, spans[1:])) and 20_000 < len(spans) < 99_000
    for most in (1 << 20, 100):
        monkeypatch.setattr(requests, "MAP_INTERVALS", most)
        found = requests.allowed_by_table(frame, networks, "a")
        assert all(r.allowed == inside(r.a) for r in found.collect())
        assert found.count() == len(asked)
    assert not requests.allowed_by_table(frame, networks.limit(0), "a").where("allowed").count()
